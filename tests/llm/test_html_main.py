import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.html_main import _lcs, main_text, page_lines, shared_lines


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_alignment_is_a_longest_one(a, b):
    pairs = _lcs(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) == lcs_length(a, b)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><article>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>one<li>two</ul></nav><!-- <p>no</p> --><div class="cookie-notice">Accept</div>
    <article><header><h1>A &amp; B</h1></header><p>first <b>bo</b>ld &lt;x&gt;<br>next &#233;&eacute; a < b
    <p title="x > y">second<![CDATA[ a & b ]]></p><div class="ad-box">Buy</div><form>q</form><aside>s</aside><div id="comments">c</div>
    <footer>f</footer><p>last</p></article><div class="sidebar">s</div><footer>&copy; x</footer></body></html>"""
    lines, inside = page_lines(page)
    assert " ".join(x for x, a in zip(lines, inside) if a) == "A & B first bold <x> next éé a < b second a & b last"
    assert not any(x in lines for x in ("one", "Accept", "Buy", "q", "Site"))
    for odd in ("", "plain", "<", "<p", "<!--", "<p title='", "</", "<script>", "<a href=\"x>y", "&#xD800;&#99999999;"):
        page_lines(odd)
    assert page_lines("plain text")[0] == ["plain text"]


def test_long_and_broken_pages_take_linear_time():
    began = time.time()
    for piece in ("<!-- ", "<p title='", "<a b=\"", "<div>", "<script", "<li>x", "&amp", "< "):
        page_lines(piece * 100_000)
    a, b = (["same"] * 3000 + [f"{k}{i}" for i in range(3000)] for k in "ab")
    assert len(shared_lines(a, b)) == 3000
    assert time.time() - began < 60


def rows(spark, data):
    return spark.createDataFrame([(*r, "k") for r in data], "page_id long, url string, html string, text string")


def test_shared_lines_go(spark):
    rnd = random.Random(1)
    line = lambda: " ".join(str(rnd.randrange(10 ** 6)) for _ in range(8))
    data, want = [], {}
    for h in range(3):
        for i in range(40):
            own = [line() for _ in range(rnd.randint(2, 6))]
            plain = i % 2 == 0                             # half of the pages have no article element
            body = f"<p>menu of {h}</p>" + ("" if plain else "<article>") + "".join(f"<p>{x}</p>" for x in own) \
                + ("" if plain else "</article>") + f"<p>imprint {h}</p>"
            want[h * 100 + i] = " ".join(own)
            data.append((h * 100 + i, f"http://host{h}.test/a/{i:03d}?x", f"<body>{body}</body>"))
    data += [(900, None, "<p>alone</p>"), (901, "http://x.test/", None), (None, "http://y.test/", "<p>n</p>"),
             (902, "http://z.test/1", "<article><p>copied</p></article>"), (903, "http://z.test/2", "<article><p>copied</p></article>")]
    rnd.shuffle(data)
    want |= {900: "alone", 901: "", None: "n", 902: "copied", 903: "copied"}
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = main_text(rows(spark, data).repartition(5)).collect()
        assert {r["page_id"]: r["text"] for r in out} == want and len(out) == len(data)
        assert all(r["n_chars"] == len(r["text"]) for r in out)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert main_text(rows(spark, data).limit(0)).count() == 0


def texts(spark, pages):
    data = [(i, f"http://host.test/{i:03d}", h) for i, h in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in main_text(rows(spark, data)).collect()}


def test_articles_keep_the_lines_they_share(spark):
    """A sentence in the articles of all pages is theirs; a foot line that some
    template puts inside the article is not."""
    same = "<p>The same sentence stands in every article here.</p><p>Les.</p>"
    foot = "<div>All rights reserved</div>"
    pages = [f"<body><div>menu</div><article><p>own text {i}.</p>{same}{foot + '</article>' if i == 2 else '</article>' + foot}</body>" for i in range(5)]
    got = texts(spark, pages)
    assert got == {i: f"own text {i}. The same sentence stands in every article here. Les." for i in range(5)}


def test_names_of_articles_and_wrappers(spark):
    pages = ["<article>Main text.</article><article class='comment'>Nice!</article>",
             "<article><p>Main.</p><div class='comment-content'>x</div><div class='related-post'>y</div><div class='post-sharing'>s</div>"
             "<div class='content-ad'>z</div></article>",
             "<body class='has-sidebar'><div class='content with-comments'><p>Body text.</p></div><div class='sidebar'>s</div></body>",
             "<article class='post no-comments'><div class='entry-header'><h1>Head</h1></div><p>Text.</p><aside>a</aside></article>",
             "<main role='main' id='content'><p>In main.</p></main><article role='complementary'>aside</article>"]
    assert texts(spark, pages) == {0: "Main text.", 1: "Main.", 2: "Body text.", 3: "Head Text.", 4: "In main."}


def test_a_teaser_is_not_the_page(spark):
    body = "<p>One two three four five six seven.</p><p>Eight nine ten eleven twelve thirteen.</p>"
    both = "One two three four five six seven. Eight nine ten eleven twelve thirteen."
    pages = [f"<body>{body}<article class='teaser'>Teaser</article></body>", f"<body>{body}<article>Small.</article></body>",
             f"<body><article>{body}</article><p>Read more</p></body>"]
    assert [texts(spark, [p])[0] for p in pages] == [both, both + " Small.", both]


def test_references_are_decoded_within_a_text_node():
    assert page_lines("<p>a &am<b>p;</b> &amp; &lt;b&gt;</p>")[0] == ["a &amp; & <b>"]
    assert page_lines("<p>x<![CDATA[&amp;]]></p>")[0] == ["x&amp;"]


def test_ranges_follow_the_size_of_the_pages(spark, monkeypatch):
    from quarry.llm import html_main
    pages = [f"<p>menu</p><p>own line {i}</p>" for i in range(40)]
    want = texts(spark, pages)
    monkeypatch.setattr(html_main, "RANGE_BYTES", 60)
    assert texts(spark, pages) == want == {i: f"own line {i}" for i in range(40)}
