import random
import re
from html.parser import HTMLParser

import pytest

from lexiforge.llm.html_extract import extract_text, page_lines, shared_lines

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, host string, path string, k1 int, at long, text string"


class Article(HTMLParser):
    """The blocks of an article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks, self.parts = 0, [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "br"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.parts += [data] if self.inside else []

    def handle_entityref(self, name):
        from html import unescape
        self.handle_data(unescape(f"&{name};") if unescape(f"&{name};") != f"&{name};" else f"&{name}")

    def handle_charref(self, name):
        from html import unescape
        self.handle_data(unescape(f"&#{name};"))


def by_parser(html):
    p = Article()
    p.feed(html)
    p.close()
    p.cut()
    return "\n".join(p.blocks)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p", 1, 2, "t") for i, u, h in rows], SCHEMA)


def test_given_pages_match_the_standard_parser(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: by_parser(r["html"]) for r in df.collect()}
    got = {r["page_id"]: r for r in extract_text(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_markup_roles_and_character_references():
    html = ("<html><head><title>no</title><style>p{}</style></head><body class='menu-open'><header><h1>Site</h1></header>"
            "<div id=cookie-notice>We use cookies</div><main><header><h1>A&nbsp;&amp;\n B</h1></header>"
            "<p>One <b>bold</b>&#33;<p class=ad>Buy<div>Two<br>Three</div><ul><li>x<li class='promo'>y<li>z</ul>"
            "<script>var t='</p>'</script><form>Name<input></form><aside>side</aside><!-- <p>gone</p> -->"
            "<section class='readerComments'><p>nice!</p></section>4 < 5 &unknown; <span class=advert>ad</span>end</main>"
            "<footer>f</footer><p title=\"odd>quote</p>")
    assert [t for m, t in page_lines(html) if m == "m"] == ["A & B", "One bold!", "Two", "Three", "x", "z", "4 < 5 &unknown;", "end"]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a = rng.sample(range(40), rng.randint(0, 25))
        b = rng.sample(range(40), rng.randint(0, 25))
        import numpy as np
        got = shared_lines(np.array(a, "<u8"), np.array(b, "<u8"))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1] and got == sorted(got)
        it = iter(b)
        assert all(a[i] in it for i in got)
    import numpy as np
    assert shared_lines(np.array([7, 7, 8], "<u8"), np.array([7, 8, 7], "<u8")) in ([0, 1], [0, 2])


def site(k, body):
    return f"<div>Home | Contact</div><div>{body}</div><div>All rights reserved</div>"


def test_shared_lines_go_where_nothing_is_marked(spark):
    rows = [(k, f"http://a.com/blog/{k}?x=1", site(k, f"Post number {k}")) for k in range(5)]
    rows += [(10, "http://a.com/other", "<p>Alone</p>"), (11, "http://b.com/blog/1", site(11, "Only one here")),
             (12, "http://c.com/1", site(12, "mirror")), (13, "http://c.com/2", site(12, "mirror")), (14, "http://c.com/3", site(14, "third")),
             (20, None, None), (21, None, ""), (None, "http://a.com/blog/9", site(9, "Null id")), (None, "http://a.com/blog/9", site(9, "Null id"))]
    got = extract_text(pages(spark, rows)).collect()
    text = [(r["page_id"], r["text"]) for r in got]
    assert sorted((t for t in text if t[0] is not None)) == sorted(
        [(k, f"Post number {k}") for k in range(5)] + [(10, "Alone"), (11, "Home | Contact\nOnly one here\nAll rights reserved"),
                                                       (12, "Home | Contact\nmirror\nAll rights reserved"), (13, "mirror"), (14, "third"),
                                                       (20, ""), (21, "")])
    assert [t for t in text if t[0] is None] == [(None, "Null id")] * 2
    near = {r["page_id"]: (r["nearest_page_id"], r["n_lines"], r["n_shared"]) for r in got if r["page_id"] is not None}
    assert near[1] == (0, 3, 2) and near[11] == (None, 3, 0) and near[13] == (14, 3, 2)


def test_quoted_passage_stays_in_both_articles(spark):
    rows = [(k, f"http://a.com/{k}", f"<nav>Menu</nav><article><p>Own {k}</p><p>The same passage.</p></article>") for k in range(2)]
    got = extract_text(pages(spark, rows)).orderBy("page_id").collect()
    assert [(r["text"], r["n_shared"]) for r in got] == [("Own 0\nThe same passage.", 2), ("Own 1\nThe same passage.", 2)]


def test_empty_table_and_long_page(spark):
    assert extract_text(pages(spark, [])).collect() == []
    long = "<article>" + "".join(f"<p>line {k}<b>" for k in range(30_000)) + "</article>"
    row, = extract_text(pages(spark, [(1, "x", long)])).collect()
    assert row["text"].count("\n") == 29_999 and row["n_lines"] == 30_000


@pytest.mark.parametrize("html", ["<", "<a", "</", "<!--", "<p title='", "&#;&#x110000;", "<script>", "</p></div>", "<p>" * 50, "\x00<b"])
def test_broken_markup_does_no_harm(html):
    assert isinstance(page_lines(html), list)
    assert re.search("ok", " ".join(t for _, t in page_lines("<p>ok</p>" + html)))
