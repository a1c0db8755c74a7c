import html
import re

import duckdb
import pytest

from larder.llm import extraction
from larder.llm.queries import QUERIES
from tests.conftest import SMALL


def plain(page):
    """The article element of a page of the test tables: paragraphs and heading, by plain cuts."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "")) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def test_whole_table(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SMALL}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in QUERIES["op2_subsequence_extraction"](spark, SMALL).collect()}
    assert set(got) == {p for p, _, _ in pages}
    for p, url, page in pages:
        assert got[p].url == url and got[p].text == plain(page) and got[p].n_chars == len(got[p].text)


MODEL = extraction.Model({"article": -40.0, "/article": -40.0, "p": -0.05, "/p": -0.05, "h1": -0.05, "/h1": -0.05, "div": -0.5, "/div": -0.5})
P = "<p>" + "word " * 12 + "</p>"
W = ("word " * 12).strip()


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain text", "plain text"), ("<p></p>", ""), ("a &lt;b&gt; &amp; c&nbsp;d &copy e", "a <b> & c d © e"),
    (f"<nav><p>menu here</p></nav><article>{P}<p>one<b>two</b> three<br>four</p></article><footer>x y z</footer>", f"{W}\n\nonetwo three four"),
    (f"<article>{P}<aside>in between, side words {'many ' * 30}</aside>{P}</article>", f"{W}\n\n{W}"),
    (f"<article>{P}<div class='ad-box'><p>buy</p></div>{P}<section id=comments>{P}{P}{P}</section></article>", f"{W}\n\n{W}"),
    (f"<div class='stray'>five words stand out here</div><article>{P}</article><div>three more words</div>", W),
    (f"<script>var t='</p><p>x</p>'; a < b</script>{P}<style>p{{}}</style><!-- <p>no</p> -->", W),
    (f"<form><p>name</p><textarea><p>no</textarea></form>{P}<div role=navigation>a b c</div>", W),
    (f"<div class='cookieNotice'>we use<div>more</div></div>{P}<p hidden>gone</p>", W),
    (f"{P}<p>1 < 2 and 3 > 2 <p>unfinished <a href='x", f"{W}\n\n1 < 2 and 3 > 2\n\nunfinished"),
    ("<head><title>no</title><body><p class=ad>no<p>yes yes", "yes yes"),
    (f"<article><ul><li>one two<li>three</ul>{P}<a title='a > b' href=x>link text</a></article>", f"one two\n\nthree\n\n{W}\n\nlink text"),
])
def test_pages(page, want):
    assert MODEL.region(page) == want


def test_region_is_the_best(spark):
    """The scan finds the highest sum over all contiguous stretches."""
    import random
    rng = random.Random(5)
    for _ in range(60):
        page = "".join(rng.choice(["a b c ", "d ", "<p>", "</p>", "<div>", "</div>", "<article>", "</article>"]) for _ in range(25))
        model = extraction.Model({t: -rng.random() * 4 for t in ("p", "/p", "div", "/div", "article", "/article")})
        row = list(extraction.tokens(page))
        value = [model.tags[t] if t else float(len(x.split())) for t, x, _ in row]
        best = max((sum(value[a:b]) for a in range(len(row)) for b in range(a, len(row) + 1)), default=0)
        found = model.region(page).split()
        spans = [" ".join(x for t, x, _ in row[a:b] if not t).split() for a in range(len(row)) for b in range(a, len(row) + 1)
                 if abs(sum(value[a:b]) - best) < 1e-9]
        assert found in spans


def test_edge_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, t int"
    rows = [(1, "u", None, "x", 1, 1), (2, None, "", "y", 2, 2), (None, "v", P, "z", 3, 3), (2, None, "", "y", 2, 2),
            (3, "w", "<p>" * 50_000 + "deep " * 50_000, "q", 4, 4), (4, "w", "<a b='" * 3000, "q", 4, 4)]
    pages = spark.createDataFrame(rows, schema)
    got = extraction.extracted(pages, extraction.train(pages)).collect()
    assert len(got) == 6
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 59), (1, 0), (2, 0), (2, 0), (3, 5 * 50_000 - 1), (4, 0)]
    assert extraction.extracted(pages.limit(0), extraction.train(pages.limit(0))).count() == 0
