from terrafold.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<div class=box>Site %s</div><article><h1>Head &amp; line</h1><p><b>One
  two<br>three<p>Four &lt;5&gt; &eacute;&nbsp;x<div class="ad">buy</div><ul><li>a<li>b</ul>
<table><tr><td>1<td>2</table><script>var t="</p>";</script><section id=comments><p>nice!</section></article>
<footer>&copy; 2020</footer>"""


def test_main_text():
    got = html.main_text(html.parse(PAGE % "name")).split("\n")
    assert got == ["Head & line", "One two three", "Four <5> é x", "a", "b", "1", "2"]


def test_names_that_merely_hold_a_mark_keep_their_text():
    for text in (
        '<article class="post has-comments"><p>text</p></article>', '<div class="content with-sidebar"><p>text</p></div>',
        '<main><div class="article-body no-ads"><p>text</p></div></main>', '<article><p class="notice-period">text</p></article>',
        '<article><header><h3>text</h3></header></article>', '<div class="page-sidebar"><article><p>text</p></article></div>',
        '<main class="main-content widget"><p>text</p></main>',
    ):
        assert html.main_text(html.parse(text)) == "text", text
    for name in ("ad", "ads-banner", "ad-slot-1", "cookie-notice", "siteFooter sidebar", "sidebar-left", "social-share-buttons", "newsletter-signup", "related-posts", "comments-area", "main-nav"):
        page = f'<body><div class="{name}">no</div><article><p>text</p><div id="{name}">no</div></article></body>'
        assert html.main_text(html.parse(page)) == "text", name
    threads = '<main><p>text</p><section id="comments"><article class="comment"><p>nice</p></article><article><p>me too</p></article></section></main>'
    assert html.main_text(html.parse(threads)) == "text"
    assert html.main_text(html.parse("<body><header><p>Site</p></header><article><p>text</p></article></body>")) == "text"


def test_template_counts_against_brute_force(spark, monkeypatch):
    """Hosts of all sizes: which subtrees recur, from the pages' own sets of subtrees."""
    from collections import Counter, defaultdict
    from fractions import Fraction

    rng = __import__("random").Random(2)
    rows = []
    for host, n in (("a", 2), ("b", 3), ("c", 5), ("d", 12), ("e", 60)):
        bits = [f"<div><i>{host} site part {k}</i></div>" for k in range(12)]
        for i in range(n):
            some = "".join(b for k, b in enumerate(bits) if rng.random() < (k + 1) / 12)
            rows.append((len(rows), f"http://{host}.example/{i}", f"<body>{some}<div><h2>{host} {i}</h2><p>own {rng.random()}</p></div></body>"))
    pages, seen = Counter(), defaultdict(Counter)
    for _, url, text in rows:
        host = url.split("/")[2]
        pages[host] += 1
        seen[host].update(html.candidates(html.parse(text)))
    want = {}
    for host, counts in seen.items():
        n = pages[host]
        least = max(Fraction(n, 5), min(8, max(3, Fraction(3 * n, 5))))
        if found := sorted(k for k, c in counts.items() if c >= least):
            want[host] = found
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: sorted(k % (1 << 64) for k in r.templates) for r in html.templates(df).collect()}
    assert got == want and {"b.example", "e.example"} <= set(want) and "a.example" not in want
    texts = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(texts[i] == html.main_text(html.parse(t), frozenset(want.get(u.split("/")[2], ()))) for i, u, t in rows)


def test_odd_pages():
    for text, want in [("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("a < b", "a < b"), ("<div>x</span>y</div>", "xy"),
                       ("<script>never closed", ""), ("<b>" * 20000 + "deep", "deep"), ("</p></p>z<", "z<")]:
        assert html.main_text(html.parse(text)) == want


def test_templates_go_and_shared_articles_stay(spark):
    body = "<div><div class=x><i>Welcome to our site</i></div><div><h2>Own %d</h2><p>%s</p></div></div>"
    rows = [(i, "http://a.example/%d" % i, body % (i, "text %d" % i), None, 5) for i in range(30)]
    rows += [(100 + i, "http://b.example/%d" % i, "<article><p>Shared by many pages</p></article>", None, 5) for i in range(30)]
    rows += [(200, None, body % (1, "x"), None, 5), (201, "http://c.example/", None, None, 5), (201, "http://c.example/", None, None, 5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, templates int")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[3] == "Own 3\ntext 3"
    assert text[105] == "Shared by many pages"
    assert text[200].startswith("Welcome") and text[201] == ""
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
