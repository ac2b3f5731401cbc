"""HTML extraction by equivalence-class template deduction.

Pages are tokenised: tags with the path of elements that holds them, and pieces of text. Tokens of one host with the same
occurrence vector (how often each page has them) form a class. Classes that more than half of the host's pages have are
kept if their tokens stand in the same order in every page, and if in every page their spans nest in gaps of the other
kept classes or these in theirs; together they are the host's template. Its gaps are the slots. Template text is no page's
own and goes on all pages, in articles too if enough pages bear witness. Of the slots' text, that in the article is
extracted where a page element says what the article is. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts and comments are left out wherever they stand.

A template is deduced from all of a host's pages, wherever they lie. An occurrence vector is held as the number of pages and a
128-bit exclusive or of hashes of (page, count), which tasks merge in any order; order and nesting are judged page by
page, and what a page finds wrong is merged. Only token hashes move, and pages meet their host's template in a join.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, frugal, mix, small_batches, stored

#: Distinct pages that must have a text in an article before it counts as template: fewer may be copies of one article.
WITNESSES = 8
#: Tokens that a task gathers before it hands their counts on.
GATHERED = 1_000_000
U64 = np.uint64
SCHEMA = "page_id long, url string, text string, n_chars long"
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# Elements by what they are.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = RAW | {
    "head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "svg", "object", "canvas", "audio", "video", "dialog",
    "datalist"
}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul br".split()
)
CLOSES_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head", "title"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html"}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscri\w*|signup|login|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|comments?|disqus|replies|reply|respond|related|recommend\w*|share|sharing|social|popup|modal|overlay|pagination|pager|tags|toolbar|copyright|legal|disclaimer|skip)(?:$|[\s_-])",
    re.I
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-])", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def token(kind: bytes, text: str = "") -> int:
    """64-bit hash of a token, the same in every process."""
    return xxhash.xxh3_64_intdigest(kind + text.encode("utf-8", "surrogatepass"))


class Piece:
    """A token of a page: a tag or a piece of text, its key for the template and what it lies in."""

    __slots__ = ("key", "text", "skipped", "level")

    def __init__(self, key, text, skipped, level):
        self.key, self.text, self.skipped, self.level = key, text, skipped, level


def attributes(raw: str) -> tuple[str, str, bool]:
    """(class and id, role, hidden)."""
    names, role, hidden = [], "", False
    for name, value in ATTR.findall(raw):
        value, name = value.strip("\"'"), name.lower()
        if name in ("class", "id"):
            names.append(value)
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDING.search(value):
            hidden = True
    return " ".join(names), role, hidden


def parse(page: str) -> list[Piece]:
    """Pieces in page order. level: 3 in an article, 2 in the main element, 1 in one named like content, else 0."""
    out: list[Piece] = []
    stack: list[tuple] = [("", 0, False, 0)]  # name, path, skipped, level
    at, end = 0, len(page)

    def text(raw):
        if raw:
            name, path, skipped, level = stack[-1]
            out.append(Piece(token(b"#%d " % path, raw), raw, skipped, level))

    def boundary(name):
        if name in BLOCK:
            out.append(Piece(None, None, True, 0))

    def close(k):
        for name, path, _, _ in reversed(stack[k:]):
            boundary(name)
            out.append(Piece(token(b">%d" % path), None, True, 0))
        del stack[k:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                boundary(name)
            continue
        if name in CLOSES_P or name in SIBLINGS:
            ends = SIBLINGS.get(name) or {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in SCOPES or name not in SIBLINGS and stack[k][0] in BLOCK:
                    break
        names, role, hidden = attributes(m[3]) if m[3] else ("", "", False)
        _, path, skipped, level = stack[-1]
        path = token(b"%d " % path, f"{name} {names}")
        boundary(name)
        out.append(Piece(token(b"<%d" % path), None, True, 0))
        if name in VOID or m[3].endswith("/") and name in VOID:
            continue
        own = 3 if name == "article" else 2 if name == "main" or role == "main" else 1 if names and MAIN.search(names) and name in ("div", "section", "td") else 0
        skipped = skipped or hidden or name in SKIPPED or role in ROLES or bool(
            names and name not in ("html", "body", "article", "main") and BOILERPLATE.search(names)
        )
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            out.append(Piece(token(b">%d" % path), None, True, 0))
            continue
        stack.append((name, path, skipped, max(level, own)))
    close(1)
    return out


def skeleton(page: str) -> np.ndarray:
    """The hashes of a page's tokens, in order."""
    return np.array([p.key for p in parse(page) if p.key is not None], U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def occurrences(pages: list[np.ndarray], marks: list[int]) -> tuple[np.ndarray, ...]:
    """(token, pages that have it, most in a page, two 64-bit halves of its occurrence vector) over distinct pages, each with a mark."""
    found = [np.unique(p, return_counts=True) for p in pages]
    key = np.concatenate([k for k, _ in found] or [np.zeros(0, U64)])
    n = np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)])
    page = np.repeat(np.array(marks, U64), [len(k) for k, _ in found])
    o = np.argsort(key, kind="stable")
    key, n, page = key[o], n[o], page[o]
    if not len(key):
        return key, n, n, page, page
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    with np.errstate(over="ignore"):
        h = mix(page ^ mix(n.astype(U64) + U64(1)))
        return key[first], np.diff([*first, len(key)]), np.maximum.reduceat(n, first), np.bitwise_xor.reduceat(h, first), np.bitwise_xor.reduceat(mix(h + U64(77)), first)


def classes(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens in order, number of the class of each, pages of each class) of rows (token, pages, most, vector, vector).

    Classes are numbered as they are judged: those of most pages first, then of fewest occurrences, then the largest. A
    token alone in its class has the number -1.
    """
    groups: dict = {}
    for t, n, most, x, y in rows:
        groups.setdefault((n, most, x, y), []).append(t)
    ranked = sorted((-k[0], k[1], -len(v), min(v), v) for k, v in groups.items() if len(v) > 1)
    number = {t: c for c, g in enumerate(ranked) for t in g[4]}
    tokens = np.sort(np.array([r[0] for r in rows], np.int64).view(U64))
    return tokens, np.array([number.get(t, -1) for t in signed(tokens).tolist()], np.int64), np.array([-g[0] for g in ranked], np.int64)


def faults(seq: np.ndarray, cls: np.ndarray, n_classes: int) -> list[tuple[int, int, int]]:
    """What a page says of the classes: (class, -1, hash of its tokens' order), (class, class, 0) if the order is broken, (class, other, 0) if neither nests in the other.

    seq: the page's tokens that are in a class, as numbers; cls: their classes.
    """
    out = []
    of = cls[seq]
    runs = []
    for c in np.unique(of).tolist():
        at = np.flatnonzero(of == c)
        size = int((cls == c).sum())
        own = seq[at]
        if len(own) % size or (own.reshape(-1, size) != own[:size]).any() or len(np.unique(own[:size])) < size:
            out.append((c, c, 0))
            continue
        out.append((c, -1, int(np.int64(xxhash.xxh3_64_intdigest(own[:size].tobytes()) >> 1))))
        runs += [(c, a, b) for a, b in zip(at[::size].tolist(), at[size - 1 :: size].tolist())]
    inside = np.zeros((n_classes, n_classes), bool)
    for lo in range(0, n_classes, 128):
        some = np.arange(lo, min(lo + 128, n_classes))
        seen = np.zeros((len(of) + 1, len(some)), np.int32)
        np.cumsum(of[:, None] == some, axis=0, out=seen[1:])
        for c, a, b in runs:
            inside[c, some] |= seen[b + 1] > seen[a]
    crossed = inside & inside.T
    out += [(i, j, 0) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(crossed))) if i < j]
    return out


def valid_classes(n_classes: int, broken: set[int], crossed: set[tuple[int, int]]) -> list[int]:
    """Classes in order, each if it is whole and nests with all that were taken before."""
    taken: list[int] = []
    for c in range(n_classes):
        if c not in broken and not any((k, c) in crossed for k in taken):
            taken.append(c)
    return taken


def template_of(tokens, cls, pages, found) -> tuple[np.ndarray, np.ndarray]:
    """(template's tokens, those that enough pages have to go from articles too). found: (class, other, least hash, greatest hash)."""
    broken = {i for i, j, lo, hi in found if j == i or j < 0 and lo != hi}
    taken = valid_classes(len(pages), broken, {(i, j) for i, j, _, _ in found if i < j})
    inside = np.isin(cls, taken)
    return tokens[inside], tokens[inside & (np.append(pages, 0)[cls] >= WITNESSES)]


def deduce(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The template of distinct pages' skeletons, in this process."""
    if len(pages) < 2:
        return np.zeros(0, U64), np.zeros(0, U64)
    found = occurrences(pages, list(range(len(pages))))
    rows = [r for r in zip(*(x.tolist() for x in (signed(found[0]), found[1], found[2], signed(found[3]), signed(found[4])))) if 2 * r[1] > len(pages)]
    tokens, cls, n = classes(rows)
    merged: dict = {}
    for page in pages:
        for i, j, h in faults(numbered(page, tokens, cls), cls, len(n)):
            merged.setdefault((i, j), set()).add(h)
    return template_of(tokens, cls, n, [(i, j, min(h), max(h)) for (i, j), h in merged.items()])


def numbered(page: np.ndarray, tokens: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Numbers of the page's tokens that are in a class."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(tokens, page), len(tokens) - 1)
    return at[(tokens[at] == page) & (cls[at] >= 0)]


def slots(page: list[Piece], template) -> list[list[Piece]]:
    """The pieces between neighbouring template tokens, of which only block boundaries stay."""
    out: list[list[Piece]] = [[]]
    for p in page:
        if p.key in template and p.text is None:
            out.append([])
        else:
            out[-1].append(p)
    return out


def joined(pieces) -> str:
    """Blocks' text: character references decoded, white space made one space, trimmed, joined by a space."""
    parts = [" " if p.key is None else html_lib.unescape(p.text) for p in pieces if p.key is None or p.text is not None]
    return " ".join("".join(parts).split())


def main_of(page: str | None, template, sure) -> str:
    """Main text of a page: its slots' text that is not the template's, of the element that is most an article."""
    parsed = parse(page or "")
    level = max((p.level for p in parsed if p.text is not None and not p.skipped and p.text.strip()), default=0)
    gone = sure if level > 1 else template
    return joined(
        p for slot in slots(parsed, template) for p in slot if p.key is None or p.text is not None and not p.skipped and p.level >= level and p.key not in gone
    )


def extract(pages: list[str | None]) -> list[str]:
    """Main text of each page of one host, in this process."""
    template, sure = (frozenset(x.tolist()) for x in deduce([skeleton(h) for h in dict.fromkeys(pages) if h]))
    return [main_of(h, template, sure) for h in pages]


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def batch_of(cols, types, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def tokenised(batches):
    """(host, html) to (host, mark, tokens); pages without html have no row."""
    import pyarrow as pa

    for batch in batches:
        rows = [
            (h, xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")), skeleton(t).tobytes()) for h,
            t in zip(*(c.to_pylist() for c in batch.columns)) if t
        ]
        if rows:
            yield batch_of(zip(*rows), (pa.string(), pa.binary(), pa.binary()), ("host", "mark", "tokens"))


def mark_of(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "little")


def counted(batches):
    """(host, mark, tokens) of distinct pages to what each token counts in the task."""
    import pyarrow as pa

    held: dict = {}
    size = 0

    def done():
        for name, rows in held.items():
            cols = occurrences([np.frombuffer(t, U64) for _, t in rows], [mark_of(m) for m, _ in rows])
            key, n, most, x, y = signed(cols[0]), cols[1], cols[2], signed(cols[3]), signed(cols[4])
            yield batch_of(([name] * len(key), key, n, most, x, y), (pa.string(), *(pa.int64(),) * 5), ("host", "token", "n", "most", "x", "y"))

    for batch in batches:
        for name, mark, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(name, []).append((mark, tokens))
            size += len(tokens) // 8
        if size > GATHERED:
            yield from done()
            held, size = {}, 0
    yield from done()


def numbered_classes(batches):
    """(host, rows of its frequent tokens) to (host, tokens, cls, pages)."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for name, rows in zip(*(c.to_pylist() for c in batch.columns)):
            tokens, cls, n = classes([(r["token"], r["n"], r["most"], r["x"], r["y"]) for r in rows])
            if len(n):
                out.append((name, tokens.tobytes(), cls.astype("<i4").tobytes(), n.astype("<i8").tobytes()))
        if out:
            yield batch_of(zip(*out), (pa.string(), *(pa.binary(),) * 3), ("host", "tokens", "cls", "pages"))


def unpacked(tokens: bytes, cls: bytes, pages: bytes):
    return np.frombuffer(tokens, U64), np.frombuffer(cls, "<i4").astype(np.int64), np.frombuffer(pages, "<i8")


def judged(batches):
    """(host, skeleton, tokens, cls, pages) to a task's distinct (host, i, j, hash) of faults()."""
    import pyarrow as pa

    known: dict = {}
    seen, out = set(), {}

    def rows():
        if out:
            yield batch_of(
                zip(*((*k, *v) for k, v in out.items())), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()),
                ("host", "i", "j", "lo", "hi")
            )
        for x in (known, seen, out):
            x.clear()

    for batch in batches:
        if len(known) > 1000 or len(seen) > 100_000 or len(out) > 100_000:
            yield from rows()
        for name, page, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if name not in known:
                known[name] = unpacked(*rest)
            tokens, cls, n = known[name]
            seq = numbered(np.frombuffer(page, U64), tokens, cls)
            form = (name, xxhash.xxh3_128_digest(seq.tobytes()))
            if form not in seen:
                seen.add(form)
                for i, j, h in faults(seq, cls, len(n)):
                    lo, hi = out.get((name, i, j), (h, h))
                    out[name, i, j] = (min(lo, h), max(hi, h))
    yield from rows()


def chosen(batches):
    """(host, tokens, cls, pages, found) to (host, template, sure)."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for name, tokens, cls, n, found in zip(*(c.to_pylist() for c in batch.columns)):
            every, sure = template_of(*unpacked(tokens, cls, n), [(r["i"], r["j"], r["lo"], r["hi"]) for r in found or []])
            out.append((name, every.tobytes(), sure.tobytes()))
        if out:
            yield batch_of(zip(*out), (pa.string(), pa.binary(), pa.binary()), ("host", "template", "sure"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, sure), stored, of hosts with two distinct pages or more; pages: host, html. Token hashes, packed.

    Deduced from all distinct pages of the host: the result does not depend on how they are dealt out. A host's frequent tokens
    are gathered in one row: at most twice as many as its pages have on average. All else of a host is merged in parts.
    """
    pages = stored(
        pages.select("host", "html").mapInArrow(
            frugal(tokenised), "host string, mark binary, tokens binary"
        ).groupBy("host", "mark").agg(F.first("tokens").alias("tokens"))
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("size")).where("size > 1")
    tokens = pages.mapInArrow(frugal(counted), "host string, token long, n long, most long, x long, y long").groupBy("host", "token").agg(
        F.sum("n").alias("n"), F.max("most").alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    often = tokens.join(sizes, "host").where(F.col("n") * 2 > F.col("size"))
    rows = often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "n", "most", "x", "y"))).alias("rows"))
    found = stored(rows.mapInArrow(numbered_classes, "host string, tokens binary, cls binary, pages binary"))
    faulty = pages.select("host", F.col("tokens").alias("page")).join(found, "host").select("host", "page", "tokens", "cls", "pages").mapInArrow(
        judged, "host string, i int, j int, lo long, hi long"
    )
    merged = faulty.groupBy("host", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("host").agg(
        F.collect_list(F.struct("i", "j", "lo", "hi")).alias("found")
    )
    out = stored(
        found.join(merged, "host", "left").select("host", "tokens", "cls", "pages", "found").mapInArrow(
            chosen, "host string, template binary, sure binary"
        )
    )
    dropped(pages, found)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page has an empty text; null urls share a host; a host with one distinct page has no template, and
    its pages are judged by their elements. Copies of a page count once in its host's template. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no row. Pages meet templates in a join that Spark broadcasts
    only if the stored templates are under its threshold.
    """
    import pyarrow as pa

    small_batches(pages.sparkSession, 256)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host(F.col("url").cast("string")).alias("host")
    )
    found = templates(rows)

    def run(batches):
        known: dict = {b"": frozenset()}

        def tokens_of(packed):
            packed = packed or b""
            if packed not in known:
                if len(known) > 1000:
                    known.clear()
                known[packed] = frozenset(np.frombuffer(packed, U64).tolist())
            return known[packed]

        for batch in batches:
            ids, urls, htmls, every, sure = (c.to_pylist() for c in batch.columns)
            texts = [main_of(h, tokens_of(t), tokens_of(s)) for h, t, s in zip(htmls, every, sure)]
            yield batch_of(
                (ids, urls, texts, [len(t) for t in texts]), (pa.int64(), pa.string(), pa.string(), pa.int64()),
                ("page_id", "url", "text", "n_chars")
            )

    return rows.join(found, "host", "left").select("page_id", "url", "html", "template", "sure").mapInArrow(frugal(run), SCHEMA)
