"""SQL with the results of the operators that SQL can express: plain statements of what is asked, for tables of some thousand rows."""

from __future__ import annotations

from . import ball_tree, mpeg, quality

#: Words and lines; DuckDB's regular expressions take the same classes.
WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every pair of documents that share a shingle is counted, links are closed by recursion.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
t AS (SELECT doc_id, unnest(shingles) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

#: Every 50-byte string, as hexadecimal digits, with the least document that has it.
PASSAGES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
x AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.g = m.g WHERE m.least < w.doc_id),
o AS (SELECT doc_id, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS INT) AS new FROM x),
y AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
z AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM y GROUP BY ALL),
e AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM z),
c AS (SELECT e.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS b, sum(b - a) AS removed, count(*) AS spans FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""


def quality_sql() -> str:
    """The counts, and the limits from sorted lists where the engine has sketches."""
    levels = ", ".join(map(str, quality.LEVELS))
    rate = lambda m, size: f"1000.0::DOUBLE * ({m} + {quality.PRIOR[m][0]}) / ({size} + {quality.PRIOR[m][1]})"
    gaps = " ".join(f"WHEN '{m}' THEN {gap}" for m, gap in quality.GAPS.items())
    at = lambda column, p: f"{column}[greatest(1, CAST(ceil(CAST({p} AS DOUBLE) * len({column})) AS BIGINT))]"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM documents),
w3 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM w3 GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ln) AS lines FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, {rate("n_symbols", "word_chars")} AS symbol_rate, {rate("n_dup_lines", "lines")} AS dup_line_rate, {rate("n_repeat_words", "n_words")} AS repeat_rate FROM m),
v0 AS (UNPIVOT (SELECT doc_id, lang, source, failed, symbol_rate, dup_line_rate, repeat_rate FROM x) ON symbol_rate, dup_line_rate, repeat_rate INTO NAME metric VALUE raw),
v AS (SELECT *, ceil(raw * {float(quality.STEPS)}::DOUBLE) / {float(quality.STEPS)} AS rate FROM v0),
own AS (SELECT lang, source, metric, list_sort(list(rate)) AS a, list_sort(list(rate) FILTER (NOT failed)) AS g FROM v GROUP BY ALL),
lg AS (SELECT lang, metric, list_sort(list(rate) FILTER (NOT failed)) AS l FROM v GROUP BY ALL),
ca AS (SELECT metric, list_sort(list(rate) FILTER (NOT failed)) AS c FROM v GROUP BY ALL),
lv AS (SELECT own.lang, own.source, own.metric, k, ({at("g", "p")} * len(g) + {at("l", "p")} * {quality.BACKING}) / (len(g) + {quality.BACKING}) AS b FROM own JOIN lg ON own.lang IS NOT DISTINCT FROM lg.lang AND own.metric = lg.metric, (SELECT unnest([{levels}]) AS p, unnest(range({len(quality.LEVELS)})) AS k)),
st AS (SELECT *, b - lag(b) OVER (PARTITION BY lang, source, metric ORDER BY k) > CASE metric {gaps} END AS gap FROM lv),
ed AS (SELECT lang, source, metric, max(b) FILTER (k < coalesce(stop, 99)) AS finish FROM (SELECT *, min(k) FILTER (gap) OVER (PARTITION BY lang, source, metric) AS stop FROM st) GROUP BY ALL),
li AS (SELECT own.lang, own.source, own.metric, greatest(coalesce({quality.SLACK} * finish, -1), {quality.SLACK} * {at("a", 0.75)} + {quality.REACH} * ({at("a", 0.75)} - {at("a", 0.5)})) AS most, {at("c", quality.CAP)} AS cap FROM own JOIN ca ON ca.metric = own.metric LEFT JOIN ed ON ed.lang IS NOT DISTINCT FROM own.lang AND ed.source IS NOT DISTINCT FROM own.source AND ed.metric = own.metric),
ok AS (SELECT v.doc_id, bool_and(CASE v.metric WHEN 'symbol_rate' THEN x.n_symbols WHEN 'dup_line_rate' THEN x.n_dup_lines ELSE x.n_repeat_words END = 0 OR raw <= CASE WHEN cap IS NULL THEN most ELSE least(most, {quality.SLACK} * cap) END) AS fine FROM v JOIN x ON x.doc_id = v.doc_id JOIN li ON li.lang IS NOT DISTINCT FROM v.lang AND li.source IS NOT DISTINCT FROM v.source AND li.metric = v.metric GROUP BY v.doc_id)
SELECT x.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed, NOT failed AND fine AS kept FROM x JOIN ok ON ok.doc_id = x.doc_id
"""


def fixity_sql(one_in: int = 64) -> str:
    """The audit of a damaged replica, for pages with different ids of 0 or more: records and damage as bytes, the tree level by level."""

    def level(n: int, below: str, key: str) -> str:
        child = f"{key} || ':' || hash || ':' || (start - base) || ':' || (stop - base) || '|'"
        based = f"SELECT *, min(start) OVER (PARTITION BY {key} >> 4) AS base FROM {below}"
        return f"n{n} AS (SELECT {key} >> 4 AS k{n}, sha256('{n}|' || string_agg({child}, '' ORDER BY {key})) AS hash, min(start) AS start, max(stop) AS stop FROM ({based}) GROUP BY 1)"

    half, other = "(len(h) // 4)", "CASE WHEN substr(h, 2 * (len(h) // 4) - 1, 2) = '23' THEN '25' ELSE '23' END"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH p AS (SELECT page_id, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % {one_in} AS lot, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10)
  || coalesce('WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', ' ', 'g') || chr(13) || chr(10), '') || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
a AS (SELECT page_id, page_id >> 12 AS shard, lot, hex(encode(record)) AS h FROM p),
f AS (SELECT *, sha256(unhex(h)) AS digest, CAST(len(h) // 2 AS BIGINT) AS length FROM a),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY shard ORDER BY page_id {before}), 0) AS BIGINT) AS start FROM f),
d AS (SELECT page_id, shard, CASE lot WHEN 0 THEN substr(h, 1, 2 * {half} - 2) || {other} || substr(h, 2 * {half} + 1) WHEN 2 THEN substr(h, 1, 2 * {half} - 2) || {other} || substr(h, 2 * {half} - 1) ELSE h END AS h FROM a WHERE lot <> 1),
r AS (SELECT *, sha256(unhex(h)) AS r_digest, CAST(len(h) // 2 AS BIGINT) AS r_length, CAST(coalesce(sum(len(h) // 2) OVER (PARTITION BY shard ORDER BY page_id {before}), 0) AS BIGINT) AS r_start FROM d),
n0 AS (SELECT page_id AS k0, sha256('0|' || page_id || ':' || digest || ':' || length || ':1|') AS hash, start, start + length AS stop FROM o),
{level(1, "n0", "k0")},
{level(2, "n1", "k1")},
{level(3, "n2", "k2")},
s AS (SELECT o.*, r.*, CASE WHEN r.page_id IS NULL THEN 'lost' WHEN r_digest <> digest THEN 'changed' ELSE 'intact' END AS status FROM o LEFT JOIN r ON r.page_id = o.page_id)
SELECT s.page_id, s.shard, status, status = 'intact' AS intact, s.start AS "offset", s.length, digest AS record_sha256, CASE WHEN status = 'changed' THEN r_start END AS replica_offset, CASE WHEN status = 'changed' THEN r_length END AS replica_length, CASE WHEN status = 'changed' THEN r_digest END AS replica_sha256, n3.hash AS shard_root FROM s JOIN n3 ON n3.k3 = s.shard
"""


def media_sql() -> str:
    """Texts as frames in hexadecimal digits. All frames have the same header, checksum and side information, as the latter is empty."""
    tag, unit = mpeg.tag(0).hex(), mpeg.UNIT
    head = mpeg.encode(b"\0" * unit)[len(tag) // 2 :][: mpeg.BODY].hex()
    zeros = lambda n: "00" * n
    table = [0] * 256
    for i in range(256):
        x = i
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        table[i] = x
    crc = lambda data: f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda a, b: xor((CAST({table} AS BIGINT[]))[1 + (xor(a, b) & 255)], a >> 8)))"
    byte = lambda h: f"list_transform(range(0, len({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))"
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, h || repeat('FF', CAST(CASE WHEN len(h) = 0 THEN {unit} ELSE ({unit} - len(h) // 2 % {unit}) % {unit} END AS BIGINT)) AS h FROM d),
n AS (SELECT *, len(h) // {2 * unit} AS n, (len(h) // {2 * unit} + 1) * {mpeg.FRAME} AS total FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, n), lambda i: '{head}' || substr(h, {2 * unit} * i + 1, {2 * unit}) || '{zeros(mpeg.FRAME - mpeg.BODY - unit)}'), 'string_agg', '') AS body,
  list_aggregate(list_transform(range(0, 100), lambda k: printf('%02x', least(255, (k * (n + 1) // 100) * {mpeg.FRAME} * 256 // total))), 'string_agg', '') AS seek,
  list_transform(range(0, n), lambda i: CAST({len(tag) // 2 + mpeg.FRAME} + {mpeg.FRAME} * i AS BIGINT)) AS offsets FROM n),
m AS (SELECT *, '{tag}{head}' || '{b"Xing".hex()}00000007' || printf('%08x', n) || printf('%08x', total) || seek || '{zeros(mpeg.FRAME - mpeg.BODY - 116)}' || body AS media,
  list_aggregate(list_transform(offsets, lambda x: list_aggregate(list_transform(range(0, 8), lambda k: printf('%02x', x >> (8 * k) & 255)), 'string_agg', '')), 'string_agg', '') AS packed, substr(h, len(h) - 63) AS tail, gcd(3 * n, 125) AS g FROM b)
SELECT doc_id, n_bytes, CAST(len(h) // 2 AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256, {crc(byte("tail"))} AS tail_crc32, CAST(len(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
 'frames=' || n || ';samples=' || 1152 * n || ';seconds=' || 3 * n // g || CASE WHEN g < 125 THEN '/' || 125 // g ELSE '' END || ';bad=0;skipped=0;vbr=' || n || ';tags=ID3v2.4;seek=' || printf('%08x', {crc(byte("packed"))}) AS feature,
 CAST(n AS BIGINT) AS frames, CAST(1152 * n AS BIGINT) AS samples, CAST(3 * n // g AS BIGINT) AS duration_numerator, CAST(125 // g AS BIGINT) AS duration_denominator, CAST(to_json(offsets) AS VARCHAR) AS frame_offsets, CAST(n AS BIGINT) AS table_frames, CAST(total AS BIGINT) AS table_bytes, CAST(0 AS BIGINT) AS bad_checksums, CAST(0 AS BIGINT) AS skipped_bytes, '["ID3v2.4"]' AS tags FROM m
"""


def clusters_sql() -> str:
    """Centroid clustering round by round: all distances of all vectors to all centroids, component by component."""
    k, n, scale = ball_tree.CENTROIDS, ball_tree.DIMENSIONS, ball_tree.SCALE
    fine = f"len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) * {scale} < {ball_tree.MOST - 1})) = {n}"
    steps = []
    for r in range(ball_tree.ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT row, k, sum((u.x - c.x) * (u.x - c.x)) AS d FROM u JOIN c{r} c ON u.j = c.j GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY row)""")
        if r < ball_tree.ROUNDS:
            steps.append(f"""s{r} AS (SELECT a.k, u.j, sum(u.x) AS s, count(*) AS n FROM u JOIN a{r} a ON u.row = a.row GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.k, c.j, CASE WHEN s.n IS NULL THEN c.x ELSE CAST((s.s - (s.s % s.n + s.n) % s.n) // s.n AS BIGINT) END AS x FROM c{r} c LEFT JOIN s{r} s ON s.k = c.k AND s.j = c.j)""")
    last = ball_tree.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale}.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {fine}),
u AS MATERIALIZED (SELECT row, unnest(range({n})) AS j, unnest(x) AS x FROM v),
o AS (SELECT x, row_number() OVER (ORDER BY coalesce(sha256('{ball_tree.SEED}:' || vec_id), 'none'), x) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT CAST(k AS INT) AS k, unnest(range({n})) AS j, unnest(x) AS x FROM o WHERE k < {k}),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c{last} GROUP BY k)
SELECT v.vec_id, a.k AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{last} a JOIN v ON v.row = a.row JOIN h ON h.k = a.k
"""
