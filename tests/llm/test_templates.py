"""Template deduction on generated sites whose main text is known, and the scanner on malformed pages."""

import random

import pytest

from rankmart.llm import templates
from rankmart.llm.html_scan import Scanner
from rankmart.llm.registry import prepare

SCHEMA = "page_id long, url string, html string, host string, role long, text string, key int"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in templates.extract(frame(spark, rows)).collect()}


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 999)) for _ in range(n)) + "."


def site(rng, n, host, page):
    """Rows and main texts of n pages of a host."""
    rows, want = [], {}
    for i in range(n):
        paragraphs = [prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        rows.append((len(host) * 1000 + i, f"https://{host}/p/{i}?x=1", page(rng, i, paragraphs)))
        want[rows[-1][0]] = "\n".join(paragraphs)
    return rows, want


def plain_divs(rng, i, ps):
    """No element or class tells the parts apart: only the template does."""
    body = "".join(f"<p>{p}</p>" for p in ps)
    return (f"<html><head><title>t {i}</title></head><body><div class=x1><div><a href=/a>Home</a> <a href=/b>News</a></div></div>"
            f"<div class=x2><div>Welcome to our pages, we hope you enjoy them</div><div class=x3>{body}<p>Please tell your friends about us</p></div></div>"
            f"<div class=x4><p>All rights kept by the owners of page {i}</p></div></body></html>")


def articles(rng, i, ps):
    body = "".join(f"<p>{p}" for p in ps)  # paragraphs left open
    comments = "".join(f"<div class=comment><p>{prose(rng, 6)}</p></div>" for _ in range(rng.randint(0, 4)))
    return (f"<!doctype html><body class='has-sidebar'><header><p>Site {i}</p></header><NAV><ul><li>one<li>two</ul></NAV><!-- <p>not text</p> -->"
            f"<div class='page with-sidebar'><article>{body}<aside>{prose(rng, 5)}</aside><form><p>Your name</p></form></article></div>"
            f"<section id=comments>{comments}</section><script>var x = '<p>no</p>';</script><footer>{prose(rng, 4)}</footer>")


def test_sites(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for host, page, n in (("plain.example.com", plain_divs, 12), ("articles.example.org", articles, 9), ("few.example.net", articles, 2)):
        more, texts_ = site(rng, n, host, page)
        rows, want = rows + more, want | texts_
    assert texts(spark, rows) == want


def test_template_of_a_host(spark):
    """Its classes are nested, its container is the box around the paragraphs, its fixed texts are those on every page."""
    rows, _ = site(random.Random(4), 10, "plain.example.com", plain_divs)
    found = templates.templates(templates.sequences(frame(spark, rows))).collect()
    assert len(found) == 1 and found[0]["pages"] == 10 and found[0]["container"] is not None
    assert len(found[0]["fixed"]) == 5  # two links, the welcome, the plea, the owners' line with its number masked
    parents = [c["parent"] for c in found[0]["classes"]]
    assert parents[0] == -1 and all(p >= 0 for p in parents[1:]) and found[0]["classes"][0]["support"] == 10


def test_copies_of_a_page_keep_their_text(spark):
    page = plain_divs(random.Random(1), 1, ["one text that all pages of the host share, as they are copies.", "and its second part."])
    rows = [(i, "http://copies.example.com/", page) for i in range(8)] + [(8, "http://copies.example.com/x", page)]
    assert {"one text that all pages of the host share, as they are copies." in t for t in texts(spark, rows).values()} == {True}


def test_odd_rows(spark):
    long = "<p>" + "word &amp; " * 100_000 + "</p>"
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>a</p>"), (None, "http://h/x", "<p>b</p>"), (4, "http://h/x", long), (4, "http://h/x", long),
            (5, "http://h/y", "no markup &lt;at&gt; all"), (6, "http://H/z", "<div>x<p>y<br>z</div> w <b>v</b>\n\tu"), (7, "http://h/q", "a < b > c <!-- open <p>x"),
            (8, "http://h/r", "<p>cut <a href='x>y</a></p>")]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in templates.extract(frame(spark, rows)).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "a"), (None, "b"), (4, " ".join(["word &"] * 100_000)), (4, " ".join(["word &"] * 100_000)), (5, "no markup <at> all"),
            (6, "x\ny z\nw v u"), (7, "a < b > c"), (8, "cut y")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)


def test_empty_table(spark):
    out = templates.extract(frame(spark, []))
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_template_blocks"] and out.count() == 0


@pytest.mark.parametrize("page, want", [
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>a<div>b</div>c</p>d", ["a", "b", "c", "d"]),
    ("<p><b>a<p>b</b> c", ["a", "b c"]), ("<style>p{}</style>a<script>if (a < b) '</p>'</script>b", ["ab"]), ("a<br/>b<img src='>'>c", ["a bc"]),
    ("&eacute;&#233;&nbsp;&copy;", ["éé ©"]), ("<textarea><p>x</textarea>y", ["y"]), ("x</p></div>y", ["x", "y"])])
def test_blocks(page, want):
    _, blocks, _ = Scanner().scan(page)
    assert [t for t in (" ".join("".join(p[1] for p in pieces).split()) for _, pieces in blocks) if t] == want


def test_orders_and_gaps():
    """A class of two tokens in the third gap of a class of four; one out of order; one that crosses."""
    of = {1: 0, 2: 0, 3: 0, 4: 0, 10: 1, 11: 1, 20: 2, 21: 2}
    orders, gaps = templates.sequence_test([1, 2, 3, 10, 11, 10, 11, 20, 4, 21], of, [4, 2, 2])
    assert all(o is not None for _, o in orders) and (1, 0, 3) in gaps and (2, 0, -1) in gaps
    orders, _ = templates.sequence_test([1, 2, 10, 11, 11, 10, 3, 4], of, [4, 2, 2])
    assert dict(orders)[1] is None and dict(orders)[0] is not None


def test_query_on_the_smallest_tables(spark):
    """Every page's article, cut out plainly (these pages mark it by its element)."""
    import html
    import re

    from rankmart.llm.queries import QUERIES

    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(x for x in parts if x)

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op11_template_extraction"](spark, sf).collect()}
    assert got == {p["page_id"]: (p["url"], article(p["html"]), len(article(p["html"]))) for p in pages}
