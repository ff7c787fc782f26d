import html
import re

from fixtures_path import fx  # noqa: F401

from ferrule.llm import op5_html_extraction as op

SCHEMA = "page_id long, url string, html string, text string, host string, root string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "h", "r") for i, u, h in rows], SCHEMA)


def run(spark, rows):
    hosted = op.with_host(pages(spark, rows))
    return {r.page_id: r for r in op.extract(hosted, op.infer_wrappers(hosted)).collect()}


def test_query_equals_a_plain_reading_of_the_generated_pages(spark, sf):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op.query(spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = (re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)) for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r.text == want and r.n_chars == len(want)


def test_boilerplate_goes_and_text_stays(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>menu</ul></nav>
    <div class="cookie-notice">accept</div><div id="main-col"><div class="story"><h1>Title &amp; more</h1><p>One&nbsp;two<br>three
    <p>Second <a href="/x">link</a> &lt;b&gt; <b>bold</b>.<aside>side</aside><ul><li>a<li>b</ul><form><input> f</form>
    <script>var t="</p>";</script><table><tr><td>c1<td>c2</table></div></div><div class="comments"><p>reader</p></div><footer>F</footer>"""
    got = run(spark, [(i, f"http://x.org/{i}", page) for i in range(3)])[0]
    assert got.text == "\n\n".join(["Title & more", "One two three", "Second link <b> bold.", "a", "b", "c1", "c2"])


def test_odd_pages(spark):
    got = run(
        spark,
        [
            (1, None, None),
            (2, "", ""),
            (3, "nonsense", "no markup at all"),
            (4, "http://a.b/c", "<p>unclosed <b>bold"),
            (5, "http://a.b/c", "<article><p>x</p></article>"),
            (6, "http://a.b/d", "<!-- only a comment"),
            (7, "http://a.b/e", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"),
            (8, "http://a.b/f", "<article><p>" + "word " * 50_000 + "</p></article>"),
            (8, "http://a.b/f", "<article><p>again</p></article>"),
            (9, "http://a.b/g", "a < b and c > d &#65;&bogus; &copy"),
        ],
    )
    assert [got[i].text for i in (1, 2, 3, 4, 5, 6, 7)] == ["", "", "no markup at all", "unclosed bold", "x", "", "deep"]
    assert got[9].text == "a < b and c > d A&bogus; ©"
    assert run(spark, []) == {}


A = "<body><ul><li>x</li><li>y</li></ul><article><p>1</p><p>2</p></article></body>"
B = "<body><ul><li>x</li></ul><h2>h</h2><article><p>1</p></article></body>"


def test_alignment_gives_repeated_and_optional_groups():
    assert op.infer([A]).expression() == "<body> <ul> ( <li> # </li> )+ </ul> <article> ( <p> # </p> )+ </article> </body>"
    assert op.infer([A, B]).expression() == "<body> <ul> ( <li> # </li> )+ </ul> ( <h2> # </h2> )? <article> ( <p> # </p> )+ </article> </body>"


def test_elements_in_either_order_are_one_repeated_group():
    pages = ["<div><h2>a</h2><p>1</p></div>", "<div><p>2</p><h2>b</h2><p>3</p></div>"]
    assert op.infer(pages).expression() == "<div> ( ( <h2> # </h2> )? ( <p> # </p> )? )+ </div>"


def test_texts_become_slots_where_pages_differ():
    pages = [f"<body><p class=x>Same</p><div><p>{i}</p><p>more {i}</p></div></body>" for i in range(3)]
    assert op.infer(pages).expression() == "<body> <p x> = </p> <div> ( <p> # </p> )+ </div> </body>"


def test_alignment_does_not_depend_on_order():
    pages = [A, B, A.replace("1", "7"), "<body><article><p>z</p></article><ul><li>late</li></ul></body>", ""]
    whole = op.infer(pages)
    back = op.infer(pages[::-1])
    left, right = op.infer(pages[:2]), op.Wrapper.load(op.infer(pages[2:]).dump())
    left.merge(right)
    for other in (back, left):
        assert other.expression() == whole.expression() and other.template() == whole.template() and other.places == whole.places


HOST = """<body><div class="a1"><p>Our paper since 1900</p></div><div class="q"><ul><li><a href="/1">News {0}</a></li><li><a href="/2">Sports {0}</a></li><li><a href="/3">Weather</a></li></ul></div>
<div class="b"><h1>Title {0}</h1><p>Body text number {0} that is rather long.</p><p>Read more of us</p><p>Second text {0} of the story, long as well.</p></div><div class="c"><p>All rights kept</p></div></body>"""


def test_the_wrapper_decides_without_telling_names(spark):
    rows = [(i, f"http://a.org/{i}", HOST.format(i)) for i in range(5)]
    hosted = op.with_host(pages(spark, rows))
    wrappers = op.infer_wrappers(hosted)
    got = {r.page_id: r.text for r in op.extract(hosted, wrappers).collect()}
    assert got[3] == "Title 3\n\nBody text number 3 that is rather long.\n\nSecond text 3 of the story, long as well."
    without = {r.page_id: r.text for r in op.extract(hosted, wrappers.where("false")).collect()}
    assert without[3] != got[3] and "Our paper" in without[3] and "News 3" in without[3]
    row = wrappers.first()
    assert row.expression.startswith("<body> <div> <p> = </p> </div> <div q> <ul> ( <li> # </li> )+") and len(row.menus) == 1


def test_class_words_inside_an_article_say_nothing_of_it():
    for inner in ('<div class="entry-header"><h1>Title</h1></div>', '<div id="share-price"><p>Title</p></div>', '<section class="post search-theory"><p>Title</p></section>', '<h2 class="section-header">Title</h2>', '<div class="wide\n  story-header"><p>Title</p></div>'):
        assert op.extract_page(f"<article>{inner}<p>text</p></article>") == "Title\n\ntext"
    for inner in ('<div class="ad">x</div>', '<div class="ad-box left">x</div>', '<ol class="comment-list"><li><article>x</article></ol>', '<div id="sidebar">x</div>', '<div class="siteHeader">x</div>', '<div role="search">x</div>', '<div class="\n cookie-notice\n">x</div>'):
        assert op.extract_page(f"<article>{inner}<p>text</p></article>") == "text"
    assert op.extract_page('<div class="page-banner"><main><p>text</p></main></div>') == "text"  # a main text is no banner


def test_menus_inside_the_content_element_stay():
    links = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(5))
    pages = [f'<div class="x"><p>{"long story " * 20}{i}</p><ul>{links}</ul></div><div class="y"><ul>{links}</ul></div>' for i in range(4)]
    wrapper = op.infer(pages)
    assert len(wrapper.menus()) == 1
    text = op.extract_page(pages[0], [], wrapper.menus())
    assert text.count("link 3") == 1


def test_a_page_of_many_distinct_elements():
    page = "<body>" + "".join(f'<div class="{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}"><p>t{k}</p></div>' for k in range(3000)) + "</body>"
    wrapper = op.infer([page])
    assert len(wrapper.places) == 6002 and op.extract_page(page).count("\n\n") == 2999
    assert op.Wrapper.load(wrapper.dump()).places == wrapper.places


def test_a_host_in_many_tasks_and_flushes(spark, monkeypatch):
    rows = [(i, f"http://a.org/{i}", HOST.format(i)) for i in range(40)]
    hosted = op.with_host(pages(spark, rows)).repartition(7)
    one, many = op.infer_wrappers(hosted.coalesce(1)).collect(), op.infer_wrappers(hosted).collect()
    monkeypatch.setattr(op, "HELD_PLACES", 5)
    assert one == many == op.infer_wrappers(hosted).collect() and len(one) == 1


def test_headline_beside_the_body_stays(spark):
    body = "".join(f"<h2>s{k}</h2><p>p{k}</p>" for k in range(5))
    inner = f'<h1>Headline</h1><div class="content">{body}</div>'
    want = "\n\n".join(["Headline", *(f"{c}{k}" for k in range(5) for c in "sp")])
    got = run(spark, [(1, "http://a.org/1", f'<body><div class="page">{inner}</div></body>'), (2, "http://b.org/2", f"<body>{inner}</body>"), (3, "http://c.org/3", f"<body><h1>Headline</h1><article>{body}</article></body>")])
    assert {i: r.text for i, r in got.items()} == dict.fromkeys((1, 2, 3), want)


def test_texts_equal_on_all_pages_of_a_host_go(spark):
    page = '<body><div class="page"><p>Read us daily</p><h1>T{0}</h1><p>one {0}</p><div class="box7">Join our list</div><p>two {0}</p><p>kept {1}</p></div></body>'
    many = [(i, f"http://a.org/{i}", page.format(i, i % 2)) for i in range(6)]
    got = run(spark, [*many, (6, "http://a.org/empty", ""), (7, "http://b.org/7", page.format(7, 1)), (8, "http://b.org/8", page.format(7, 1))])
    assert [got[i].text for i in range(6)] == ["\n\n".join([f"T{i}", f"one {i}", f"two {i}", f"kept {i % 2}"]) for i in range(6)]
    assert got[6].text == "" and got[7].text == got[8].text and "Join our list" in got[7].text  # copies tell nothing


def test_two_versions_of_an_article_keep_their_texts(spark):
    page = "<body><h1>T</h1><p>a</p><p>b</p><p>c {0}</p></body>"
    got = run(spark, [(i, "http://a.org/", page.format(i)) for i in range(2)])
    assert got[1].text == "T\n\na\n\nb\n\nc 1"


def test_rarer_layouts_are_read_whole(spark):
    common = [(i, f"http://a.org/{i}", f'<body><div class="story">{"".join(f"<{t}>{t} {i}</{t}>" for t in tags)}</div></body>') for i, tags in enumerate(f"{a} {b} {c}".split() for a in ("h2", "p", "h3") for b in ("p", "h4") for c in ("pre", "h5", "p"))]
    rare = '<body><div class="story"><p>teaser</p></div><section><h1>Rare</h1><p>its own text</p></section></body>'
    long = f'<body><div class="{"x" * 90} story"><p>long key</p></div></body>'
    got = run(spark, [*common * 2, (99, "http://a.org/99", rare), (98, "http://a.org/98", long)])
    assert got[99].text == "teaser\n\nRare\n\nits own text" and got[98].text == "long key"


def test_no_key_is_cut():
    a, b = (op.infer([f'<body><div class="{"x" * 90} {k}"><p>t</p></div></body>']) for k in "ab")
    assert a.expression() != b.expression()
