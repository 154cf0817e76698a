import random

from pyspark.sql import functions as F

from quillforge.llm import html_extraction as h


def text(html):
    """Of a page that is alone on its host: what names and elements say decides."""
    root = h.parse(html)
    return h.extract(root, frozenset(path for path, _, kind, _, sign, _ in h.tree_rows(root) if kind == 2 and sign))


def test_markup():
    assert text("") == ""
    assert text("plain &amp; simple") == "plain & simple"
    assert text("<p>a<b>b</b>c<br>d<p>e\n\n  f</p>g") == "abc d\ne f\ng"
    assert text("<html><head><title>t</title><style>p{}</style></head><body><script>var t='</p>';</script><p>x&nbsp;&eacute;&#233;&#x1F600;</p></body>") == "x éé😀"
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\nc\n1\n2\n3"
    assert text("</div><p>a</i></p></p><div>b") == "a\nb"
    assert text("<!-- c --><p>a<!-- <p>no</p> -->b</p>") == "ab"
    assert text("<p>a<div>b</div>c</p>d") == "a\nb\nc\nd"
    assert text("<div>" * 3000 + "deep") == "deep"


def test_what_is_no_article():
    page = """<body><header><h1>Site</h1></header><nav class=x>menu</nav><div class="cookie-notice">ok?</div><aside>side</aside>
    <article><header><h1>Title</h1></header><p>One <a href=#>link</a>.</p><div class="ad-slot">buy</div><form>mail <input></form>
    <p>Two</p><section id="comments"><article class="comment"><p>first!</p></article></section></article>
    <div class="sidebar">s</div><footer>f</footer></body>"""
    assert text(page) == "Title\nOne link.\nTwo"
    assert text("<body><div class=menu>m</div><div class=content><p>a</p><div hidden>no</div></div><div role=contentinfo>f</div></body>") == "a"
    assert text("<main><p>a</p></main><p>outside</p>") == "a"
    assert text("<div class='headline shadow adapter'>kept</div>") == "kept"


def test_broken_and_deep_markup():
    assert text("<article><p>x</p><svg/><p>y</p></article>") == "x\ny"
    assert text("<p>a<svg><path d='M0'/><text>no</text></svg>b</p>") == "ab"
    assert text('<article><header class="entry-header"><h1>Title</h1></header><p>x</p></article>') == "Title\nx"
    for deep in ("<div>" * 3000, "<b><i>" * 2000, "".join(f"<div class='c{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}'>" for i in range(2500))):
        assert text(deep + "<p>text</p><script>var x=1;</script><nav>menu</nav>") == "text"
    assert text("<article>" + "<div>" * 700 + "in</div>" + "</div>" * 699 + "after</article><p>out</p>") == "in\nafter"


def pages_of_host(n):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choices(words, k=12))}</p>" for _ in range(4))
        yield f"http://h.example/{i}", f"<body><div class='xa'><span>About us</span> <span>Help</span></div><div class='xb'>{body}</div><div class='xc'>All rights reserved</div></body>"


def test_style_tree_finds_unnamed_boilerplate(spark, monkeypatch):
    many = list(pages_of_host(12))
    rows = [(i, u, p, "x") for i, (u, p) in enumerate(many)] + [(50, "http://one.example/", many[0][1], "x"), (None, None, None, "x"), (51, "http://h.example/", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    for limit in (h.BROADCAST_BRANCHES, 0):
        monkeypatch.setattr(h, "BROADCAST_BRANCHES", limit)
        got = {r["page_id"]: r["text"] for r in h.main_text(df).collect()}
        assert len(got) == len(rows)
        for i in range(12):
            assert len(got[i].split("\n")) == 4 and "About" not in got[i] and "rights" not in got[i]
        assert "About us Help" in got[50] and got[None] == "" and got[51] == ""
    assert h.main_text(df.limit(0)).collect() == []


def hosted(pages):
    return [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]


def run(spark, rows):
    return {r["page_id"]: r["text"] for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_importance_of_hand_made_nodes(spark):
    """Sixteen pages: a fixed bar, a line of two contents, and a body that every page has in its own way."""
    kinds = ["p", "ul", "ol", "table", "blockquote", "pre", "h2", "h3", "dl", "figure", "section", "b", "i", "em", "u", "strong"]
    pages = [f"<div class='bar'>Home</div><div class='line'>{'odd' if i % 2 else 'even'}</div><div class='own'><{k}>text {i}</{k}></div>" for i, k in enumerate(kinds)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(4)
    got = {r["path"]: r["importance"] for r in h.importance(df).collect()}
    place = lambda name: h._path_id(h._path_id(0, "#"), name)
    assert abs(got[place("div.bar")]) < 1e-9
    assert abs(got[place("div.line")] - 0.9 * (1 - 3 / 4)) < 1e-9  # log 8 / log 16
    assert abs(got[place("div.own")] - 1.0) < 1e-9
    low = {r["path"] for r in h.low_branches(df).collect()}
    assert low == {place("div.bar"), place("div.line")}


def test_the_tree_decides(spark, monkeypatch):
    """Names only raise the threshold: a node named like a sidebar stays where every page presents it in its own way."""
    kinds = ["p", "ul", "ol", "table", "blockquote", "pre", "h2", "h3", "dl", "figure", "section", "b"]
    pages = [f"<div class='sidebar'><{k}>story {i}</{k}></div><nav><a>m{i}</a></nav><div class='box'>Fixed</div>" for i, k in enumerate(kinds)]
    got = run(spark, hosted(pages))
    assert got == {i: f"story {i}" for i in range(12)}
    # alone on its host a page's names decide
    assert run(spark, hosted(pages[:1])) == {0: "Fixed"}
    monkeypatch.setattr(h, "low_branches", lambda pages: pages.select("host", F.lit(0).cast("long").alias("path")).limit(0))
    assert run(spark, hosted(pages))[3] == "story 3\nm3\nFixed"


def test_the_query_needs_the_tree(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    with_tree = {r["page_id"]: r["text"] for r in h.op5_html_extraction(spark, sf).collect()}
    monkeypatch.setattr(h, "low_branches", lambda pages: pages.select("host", F.lit(0).cast("long").alias("path")).limit(0))
    without = {r["page_id"]: r["text"] for r in h.op5_html_extraction(spark, sf).collect()}
    assert sum(with_tree[i] != without[i] for i in with_tree) > 0.9 * len(with_tree)


def test_very_long_pages(spark):
    page = "<article>" + "".join(f"<p>word{i} and more</p>" for i in range(60_000)) + "</article>"
    got = run(spark, [(1, "http://a.example/", page), (2, None, "<p>x"), (None, "http://a.example/", None)])
    assert len(got[1].split("\n")) == 60_000 and got[2] == "x" and got[None] == ""


def test_articles_of_the_small_table(spark, sf_small):
    """Every page of the table is one document under its title."""
    docs = {"\n".join(" ".join(x.split()) for x in r["text"].split("\n") if x.strip()) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = h.op5_html_extraction(spark, sf_small).collect()
    assert len(rows) == 50
    for r in rows:
        assert r["text"].partition("\n")[2] in docs and r["n_chars"] == len(r["text"])
