import html
import os
import re
import time

import pytest

from gradeloom.llm.html_text import equivalence_classes, extract_main_text, invalid_classes, main_text, page_events, read_page

DIR = "/root/testdata/sf0.001"


def article(page):
    """What the given pages' articles hold, found by their own simple form."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>A&nbsp; b &lt;x&gt;</p>t1<div>t2<span> t3</span></div>", "A b <x>\n\nt1\n\nt2 t3"),
        ("<header>H</header><nav>N</nav><aside>S</aside><p>x</p><footer>F</footer><form>f<input></form>", "x"),
        ("<ul><li>u<li>v</ul><table><tr><td>c<td>d</table>", "u\n\nv\n\nc\n\nd"),
        ('<script>if(a<b){"<p>no</p>"}</script><style>p{}</style><!-- <p>no</p> -->yes', "yes"),
        ('<div class="sidebar">S</div><div id="comments"><p>C</p></div><div class="adverb">in</div>', "in"),
        ("<p>one<p>two<b>bold<p>three", "one\n\ntwobold\n\nthree"),
        ("<article><h1>T</h1><p>a<br>b</p></article><p>outside</p>", "T\n\na b"),
        ("a < b & c &amp", "a < b & c &"),
        ("<p", "<p"),
        ("", ""),
        ("plain", "plain"),
        ('<p title="a>b">q</p>', "q"),
        ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_blocks(page, text):
    assert main_text(page, {}) == text


def test_deep_pages():
    page = "<div>" * 5000 + "x" + "</div>" * 5000
    assert main_text(page, {}) == "x" and len({e.key for _, e, _ in read_page(page)}) == 5001


@pytest.mark.parametrize("page", ["<a " * 100_000, "<div>" * 50_000 + "</p>" * 50_000, '<a " > "' * 50_000, "<a '" * 100_000 + ">", "<p><td>" + "<b>" * 50_000 + "<hr>" * 50_000])
def test_odd_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page, {})
    page_events(page)
    assert time.process_time() - began < 20  # a quadratic reader takes many minutes


def test_valid_classes_are_ordered_and_nested():
    classes = {1: "f", 2: "f", 3: "f", 10: "n", 11: "n", 20: "m", 21: "m"}
    members = {"f": 3, "n": 2, "m": 2}
    assert invalid_classes([1, 10, 11, 10, 11, 2, 7, 20, 21, 3], classes, members) == set()
    assert invalid_classes([1, 10, 11, 11, 10, 2, 3], classes, members) == {"n"}
    assert invalid_classes([1, 10, 2, 11, 3], classes, members) == {"n"}
    assert invalid_classes([1, 2, 10, 20, 11, 21, 3], classes, members) >= {"m"}
    assert invalid_classes([1, 2, 10, 3], classes, members) == {"n"}


def test_template_slots_without_telling_names(spark):
    """Menus and notices that only come back from page to page are left out."""
    menu = "<div class=one><span>Start</span> <span>Shop</span></div>"
    pages = [(i, f"http://h.com/{i}", f"<body>{menu}<div class=two><p>Text {i}, own words {i * i}</p><p>More {i}</p></div><div class=three>Call us now</div></body>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert got == {i: f"Text {i}, own words {i * i}\n\nMore {i}" for i in range(12)}


def test_equal_vectors_make_a_class(spark):
    pages = ["<body><ul><li><a>x</a></ul></body>", "<body><ul><li><a>x</a><li><a>y</a></ul><i>z</i></body>"]
    rows = [("h", i, said, ids, kinds) for i, (ids, kinds, said) in enumerate(map(page_events, pages))]
    seen = spark.createDataFrame(rows, "host string, page_key long, said long, ids array<long>, kinds array<byte>")
    by = {r["token"]: r for r in equivalence_classes(seen).collect()}
    of = {}
    for kind, element, _ in read_page(pages[1]):
        if kind == "open":
            of.setdefault(element.tag, by[element.key])
    assert of["body"]["vector"] == of["ul"]["vector"] != of["li"]["vector"] != of["i"]["vector"]
    assert of["li"]["vector"] == of["a"]["vector"] and of["li"]["occurrences"] == 3 and of["i"]["pages"] == 1


def test_templates_decide_where_names_tell_nothing(spark, monkeypatch):
    """All tags and classes are neutral: without the templates the menus and notices stay in."""
    page = "<body><div><div>Home</div><div>About us</div></div><div><div><div>Title {0}</div><div>By writer {0}</div></div><div>Words {0}</div></div><div><div>Call now</div></div></body>"
    page = page.replace("<div>", "<div class={c}>")
    pages = []
    for i in range(40):
        text = page
        for at in range(page.count("{c}")):
            text = text.replace("{c}", f"k{'abcdefghijkl'[at]}", 1)
        pages.append(text.format(i))
    assert extracted(spark, pages) == [f"Title {i}\n\nBy writer {i}\n\nWords {i}" for i in range(40)]
    assert main_text(pages[3], {}) == "Home\n\nAbout us\n\nTitle 3\n\nBy writer 3\n\nWords 3\n\nCall now"


def test_slots_are_told_apart_by_place(spark):
    """One and the same path holds a slogan before the title and own text after it."""
    page = "<body><div><p>Best in town</p><h1>Title {0}</h1><p>Own {0}</p></div></body>"
    assert extracted(spark, [page.format(i) for i in range(40)]) == [f"Title {i}\n\nOwn {i}" for i in range(40)]


def test_edges(spark):
    same = "<body><p>all the same</p></body>"
    rows = [(1, None, None, "t"), (2, "odd", "", "t"), (3, "http://a/1", same, "t")] + [(4, "http://a/1", same, "t")] * 12 + [(5, "http://b/", "<p>" + "long " * 100_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["n_chars"]) for r in got.collect()}
    assert got.count() == len(rows) and found == {(1, 0), (2, 0), (3, 12), (4, 12), (5, 499_999)}
    assert extract_main_text(df.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in extract_main_text(df).orderBy("page_id").collect()]


def test_slots_decide_inside_and_beside_articles(spark):
    """Teasers and notices in an article come back from page to page; the text beside it does not."""
    page = "<body><article><h2>Read this too</h2></article><div class=widget><p>Text {0}, own words</p><p>More of {0}</p></div></body>"
    assert extracted(spark, [page.format(i) for i in range(40)]) == [f"Text {i}, own words\n\nMore of {i}" for i in range(40)]
    page = "<body><article><h1>Title {0}</h1><p><b>By:</b> writer {0}</p><div>Buy now!</div></article></body>"
    assert extracted(spark, [page.format(i) for i in range(40)]) == [f"Title {i}\n\nBy: writer {i}" for i in range(40)]


def test_hints_decide_where_pages_are_few(spark):
    page = "<body><article><p>Text {0}</p></article><div>Beside {0}</div><aside>Aside {0}</aside></body>"
    assert extracted(spark, [page.format(i) for i in range(5)]) == [f"Text {i}" for i in range(5)]


def test_copies_of_pages_count_once(spark):
    """A page with many copies, some with a comment of their own, makes no template of the text that they share."""
    page = "<body><div class=one>Start</div><div class=two><h1>Title {0}</h1><p>Text {0}</p></div><div class=three>Call us now</div></body>"
    numbers = [*range(10), *[99] * 200]
    pages = [page.format(i) + "<!-- {} -->".format(at % 3) for at, i in enumerate(numbers)]
    assert extracted(spark, pages) == [f"Title {i}\n\nText {i}" for i in numbers]


READERS = """<body><nav><a>Home</a></nav><article><header class="entry-header"><h1>Title {0}</h1></header><p>Own {0}</p>
<form><label>Your ref {0}</label></form></article><div class=box>Beside {0}</div>
<section id=comments class=comments><p>Reader says {0}</p></section><aside class=sidebar>See also story {0}</aside><footer>Until {0}</footer></body>"""


@pytest.mark.parametrize("pages", [1, 5, 31, 32, 40, 400])
def test_readers_comments_sidebars_and_forms_are_out_on_every_host(spark, pages):
    assert extracted(spark, [READERS.format(i) for i in range(pages)]) == [f"Title {i}\n\nOwn {i}" for i in range(pages)]


@pytest.mark.parametrize("pages", [1, 31, 40])
def test_pages_without_an_article_leave_out_the_same(spark, pages):
    page = READERS.replace("article>", "div>").replace(" class=\"entry-header\"", "").replace("header>", "div>")
    assert extracted(spark, [page.format(i) for i in range(pages)]) == [f"Title {i}\n\nOwn {i}\n\nBeside {i}" for i in range(pages)]
    only = "<body><nav>Menu {0}</nav><footer>Until {0}</footer></body>"
    assert extracted(spark, [only.format(i) for i in range(pages)]) == [""] * pages


def test_names_of_what_stands_beside_are_text_only_for_want_of_other():
    assert main_text("<div class=related>See</div><p>Text</p>", {}) == "Text"
    assert main_text("<div class=related>See</div>", {}) == "See"
    assert main_text("<article><p>Text</p><div class=share>Tell</div></article><p>x</p>", {}) == "Text"
