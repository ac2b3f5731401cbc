import html
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidegate.llm import html_template as ht

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{margin:0}}</style><script>var t="</p><article>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>c</p> --><div class="ad">Buy {i}</div>
<article><h1>Title {i} &amp; more</h1><p>One<b>two</b> three<br>four &eacute; {i}<p>Five&nbsp;six <aside>side</aside></p><form>f<input value="x"></form>
<ul><li>a<li>b</ul><div class="comments"><p>reader {i}</p></div></article><aside>x</aside><footer>&copy; f</footer></body></html>"""


def brute_classes(pages):
    """Tokens by their whole occurrence vector, of tokens that more than half of the pages have."""
    counts = [Counter(p) for p in pages]
    out = defaultdict(list)
    for t in set().union(*counts):
        if 2 * sum(t in c for c in counts) > len(pages):
            out[tuple(c[t] for c in counts)].append(t)
    return out


def brute_template(pages):
    """Tokens of the classes that are ordered alike in every page and nest with those before them."""

    def runs(page, own):
        at = [k for k, t in enumerate(page) if t in own]
        return [at[k : k + len(own)] for k in range(0, len(at), len(own))]

    def whole(own):
        orders = {tuple(page[k] for k in run) for page in pages for run in runs(page, own)}
        return len(orders) == 1 and len(set(next(iter(orders)))) == len(own)

    def crosses(page, a, b):
        return any(
            page[k] in b for run in runs(page, a) for k in range(run[0], run[-1])
        ) and any(page[k] in a for run in runs(page, b) for k in range(run[0], run[-1]))

    taken = []
    ranked = [
        (-sum(v > 0 for v in vector), max(vector), -len(own), min(np.array(own, np.uint64).view(np.int64)), set(own)) for vector,
        own in brute_classes(pages).items() if len(own) > 1
    ]
    for *_, own in sorted(ranked, key=lambda x: x[:4]):
        if whole(own) and not any(crosses(page, own, other) for page in pages for other in taken):
            taken.append(own)
    return set().union(*taken)


def site(r, n):
    """Pages of a made-up host: a frame, repeated rows, swapped parts, crossing and odd tokens."""
    out = []
    for i in range(n):
        rows = "".join(f"<li><b>key</b> v{r.random()} <i>unit</i></li>" for _ in range(r.randint(0, 3)))
        parts = ["<div><h4>About</h4><p>Us</p></div>", "<div><h5>Mail</h5><p>Now</p></div>"]
        r.shuffle(parts)
        cross = "<u>one</u><s>two</s><u>uno</u><s>due</s>" if i % 3 else "<s>two</s><u>one</u><s>due</s><u>uno</u>"
        out.append(
            f"<html><body><div>Top</div><ul>{rows}</ul>{cross if i % 2 else ''}{''.join(parts)}<section><h2>T{i}</h2><p>text {r.random()}</p></section><div>End</div></body></html>"
        )
    return out


def test_deduction_against_brute_force(spark):
    """Templates deduced by merging over tasks are those of whole occurrence vectors; the same over any number of partitions."""
    r = random.Random(4)
    sites = {f"h{k}": site(r, n) for k, n in enumerate((1, 2, 3, 5, 9, 30))}
    rows = [(name, page) for name, pages in sites.items() for page in pages] + [("h4", sites["h4"][0])] * 30 + [("h3", None), ("h3", "")]
    for parts in (1, 3, 40):
        df = spark.createDataFrame(rows, "host string, html string").repartition(parts)
        got = {x.host: set(np.frombuffer(x.template, np.uint64).tolist()) for x in ht.templates(df).collect()}
        for name, pages in sites.items():
            want = brute_template([ht.skeleton(p).tolist() for p in pages]) if len(pages) > 1 else set()
            assert got.get(name, set()) == want
            assert len(pages) < 3 or want
            assert set(ht.deduce([ht.skeleton(p) for p in pages])[0].tolist()) == want


def test_any_partitions(spark, monkeypatch):
    """One host without article elements: the frame goes on all pages, however they are dealt out; without deduction it stays."""
    page = "<html><body><div>Site name</div><div>Home</div><div><h2>Head {i}</h2><div>Body {i}</div></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i=i)) for i in range(200)]
    want = {i: f"Head {i} Body {i}" for i in range(200)}
    for parts in (1, 3, 150):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r.page_id: r.text for r in ht.main_text(df).collect()} == want
    monkeypatch.setattr(ht, "template_of", lambda *a: (np.zeros(0, np.uint64),) * 2)
    assert ht.extract([p for _, _, p in rows])[3] == "Site name Home Head 3 Body 3 All rights reserved"


def test_article():
    got = ht.extract([PAGE.format(i=i) for i in range(4)])
    assert got == [f"Title {i} & more Onetwo three four é {i} Five six a b" for i in range(4)]
    assert ht.extract([PAGE.format(i=7)]) == ["Title 7 & more Onetwo three four é 7 Five six a b"]
    assert ht.extract([PAGE.format(i=7)] * 3) == ["Title 7 & more Onetwo three four é 7 Five six a b"] * 3


def test_template_without_names():
    """No element says what the article is: the template's own text goes, the slots stay."""
    pages = [
        f"<html><body><table><tr><td>Home</td><td>About us</td></tr></table><div><h2>Head {i}</h2><div>Body {i} text {i * i}</div></div><div>All rights reserved</div></body></html>" for i in range(6)
    ]
    assert ht.extract(pages) == [f"Head {i} Body {i} text {i * i}" for i in range(6)]
    assert any(set(v) == {1} and len(k) > 8 for v, k in brute_classes([[p.key for p in ht.parse(x) if p.key is not None] for x in pages]).items())


def test_template_text_in_articles():
    """A line without a telling class that all pages of a host have goes inside articles as well."""
    page = "<html><body><article><h1>Head {i}</h1><p>Body {i} text</p><div class='x1'><p>Read more at our shop</p><p>Thank you</p></div></article></body></html>"
    assert ht.extract([page.format(i=i) for i in range(12)]) == [f"Head {i} Body {i} text" for i in range(12)]


def test_malformed():
    assert ht.extract([None, "", "<", "<p>a", "a <b", "<script>x", "<article>t</p></article></div>u", "<!-- open"]) == ["", "", "<", "a", "a <b", "", "t", ""]
    assert ht.extract(["<article>" + "<p>x y" * 50_000])[0] == " ".join(["x y"] * 50_000)


def test_on_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in ht.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_edges(spark):
    rows = [(1, None, "<article>x</article>"), (None, "http://a/", None), (2, "http://a/", ""), (3, "junk", "<p>y</p>"), (3, "junk", "<p>y</p>")]
    pages = spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, html string, host string")
    assert sorted((r.page_id or 0, r.text) for r in ht.main_text(pages).collect()) == [(0, ""), (1, "x"), (2, ""), (3, "y"), (3, "y")]
    assert ht.main_text(pages.limit(0)).count() == 0
