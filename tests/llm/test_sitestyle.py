import functools
import random
import re
import time
from math import log

from tamis.llm import sitestyle


def text(page):
    return " ".join(sitestyle.checked(sitestyle.parsed(page), set()))


CASES = {
    "<body><header>Top</header><div class='sidebar'>s</div><main><h1>A&amp;b</h1><p>x <b>y</b>z</p><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><div class=comments><p>c</p></div><form>f</form></main><footer>f": "A&b x yz one two 1 2 3",
    "plain <b>t</b> text": "plain t text",
    "": "",
    "<p>a<script>var x='</p>'</script>b<p>c": "ab c",
    "<article><header><h1>T</h1></header>t&nbsp;t<aside>q</aside></article><article class=comment>zz</article>": "T t t",
    '<a href="x>y">k</a> < 3 <i': "k < 3 <i",
    "<nav><p>n</nav><article><p><b>One.<br><p>Two\n  three.</p><!-- <p>no</p> --></article><footer>&copy;</footer>": "One. Two three.",
    "<title>t</title><style>p{}</style><p>x&lt;y&#33;&eacute;": "x<y!é",
    "<div class='content no-sidebar'><p>kept</p></div><div id=cookie-notice>n</div><div role=navigation>n</div>": "kept",
    "<article><p>a longer text</article><p>outside": "a longer text",
    "<article><div class='rail-travel widget social'>By rail.</div><p>More<div id=comments>No!</div></article>": "By rail. More",
    "<p title='a > b' class=\"x>y\">kept<!--> too<i": "kept too<i",
    "<b>" * 9 + "x" + "</i>" * 9 + "<p>y</b>z": "x y z",
    "<table><tr><td>a<table><tr><td>b</table><td>c</table>d": "a b c d",
    "<div>a<div>b</div>c</div>": "a b c",
}


def test_markup():
    for page, want in CASES.items():
        assert text(page) == want, page
    assert text(None) == ""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, text string")


def test_repeated_branches_are_removed(spark):
    box = "<div class=box><p>Same words on every page.</p></div>"
    rows = [(i, f"http://Site.example/{i}", f"<body>{box}<div class=body><p>Story {i} tells {i * 7}.</p></div></body>") for i in range(8)]
    rows += [(100 + i, f"http://few.example/{i}", f"<body>{box}<div class=body><p>S{i}</p></div></body>") for i in range(2)]
    rows += [(200, None, f"<body>{box}</body>"), (201, "relative", None), (None, "http://site.example/x", f"<body>{box}<div class=body><p>null id</p></div>")]
    want = {**{i: f"Story {i} tells {i * 7}." for i in range(8)}, 100: "Same words on every page. S0", 101: "Same words on every page. S1", 200: "Same words on every page.", 201: "", None: "null id"}
    for few in (sitestyle.BROADCAST_BRANCHES, 0):  # sent to all tasks, or joined by host
        got = sitestyle.extract(pages(spark, rows), broadcast_branches=few).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)


def test_names_do_not_decide_before_the_tree(spark):
    box = "<nav><p>Home and about.</p></nav><div class=x><p>Same words.</p></div>"
    wrapped = [(i, f"http://form.example/{i}", f"<body><form id=page>{box}<div class=body><p>Story {i} tells {i * 7} things at length.</p></div><div class=sidebar><p>See {i}</p></div></form></body>") for i in range(8)]
    teaser = [(100 + i, f"http://cards.example/{i}", f"<body>{box}<div class=body><p>Story {i} tells {i * 7} things at some length.</p></div><article><p>More {i}</p></article></body>") for i in range(8)]
    hidden = [(200, "http://lone.example/", "<body><div class=widget><article><p>The only article.</p></article></div><p>A text outside.</p></body>")]
    got = {r.page_id: r.text for r in sitestyle.extract(pages(spark, wrapped + teaser + hidden)).collect()}
    assert all(got[i] == f"Story {i} tells {i * 7} things at length." for i in range(8))
    assert all(got[100 + i] == f"Story {i} tells {i * 7} things at some length. More {i}" for i in range(8))
    assert "The only article." in got[200]
    assert sitestyle.low_branches(sitestyle.parse(pages(spark, wrapped))).count() == 2  # menu and box


def test_hosts_without_helpful_names(spark):
    """Menus, adverts from a pool, and a long notice, in bare divs: nothing but the tree can tell them."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    pool, notice, rows, want = [" ".join(word() for _ in range(5)) for _ in range(6)], " ".join(word() for _ in range(60)), [], {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(5, 30))) for _ in range(3)]
        want[i] = " ".join(parts)
        body = "".join(f"<p>{x}</p>" for x in parts)
        rows.append((i, f"http://bare.example/{i}", f"<div><div class=q1>{r.choice(pool)}</div><div class=q2><span>{word()[:1]}</span></div><div class=q3>{notice}</div></div><div class=q4>{body}</div><div class=q5>{r.choice(pool)}</div>"))
    rows += [(100 + i, f"http://bare.example/copy{i}", re.sub("q1>[^<]*", "q1>" + r.choice(pool), rows[0][2])) for i in range(300)]  # most pages are copies of one
    got = {x.page_id: x.text for x in sitestyle.extract(pages(spark, rows)).collect()}
    assert all(got[i] == want[i] for i in want)
    assert {got[100 + i] for i in range(300)} == {want[0]}


def test_copies_of_an_article_are_no_template(spark):
    copy = "<body><article><p>The very same article.</p></article></body>"
    rows = [(i, f"http://a.example/{i}", copy) for i in range(50)] + [(100, "http://a.example/z", "<body><article><p>Another.</p></article></body>")]
    assert {r.text for r in sitestyle.extract(pages(spark, rows)).collect()} == {"The very same article.", "Another."}


def brute_importance(rows):
    """The tree of a table, branch by branch: {(host, branch): (pages, importance)}."""
    trees, text_of = {}, {}
    for _, url, html in rows:
        host = re.match(r"[a-z]+://([^/?#]*)", url or "")
        if host and html:
            trees.setdefault(host[1].lower(), []).append(sitestyle.parsed(html))
    out = {}
    for host, found in trees.items():
        for p in found:
            for x in p.blocks:
                text_of.setdefault((host, x.branch), set()).add(x.text)
        main = max(((sum(map(len, t)), b) for (h, b), t in text_of.items() if h == host), default=(0, 0))[1]
        seen = {}
        for p in found:
            of = {b: [x.text for x in p.blocks if x.branch == b] for b in {x.branch for x in p.blocks}}
            if of:
                seen.setdefault(sitestyle.shingle_hash(of[main]) if main in of else min(map(sitestyle.shingle_hash, of.values())), []).append((p, of))
        for branch in {b for h, b in text_of if h == host}:
            on = {k: [(p, of) for p, of in v if branch in of] for k, v in seen.items()}
            on = {k: v for k, v in on.items() if v}
            m = len(on)
            times = lambda what: [sum(f in {y for x in v for y in what(x)} for v in on.values()) for f in {y for v in on.values() for x in v for y in what(x)}]  # noqa: B023, E731
            styles, contents = times(lambda x: [x[0].styles.get(branch, 0)]), times(lambda x: x[1][branch])  # noqa: B023
            if m == 1:
                out[host, branch] = (1, 1.0)
                continue
            style = max(0.0, (log(m) - sum(n * log(n) for n in styles) / m) / log(m))
            content = 1 - sum(map(log, contents)) / len(contents) / log(m)
            out[host, branch] = (m, 0.1 * style + 0.9 * content)
    return out


def test_tree_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in table.collect()]
    rows += [(10_000 + i, "http://h.example/", f"<body><div class=x><p>{'same' if i % 2 else i}</p></div></body>") for i in range(6)]
    blocks = sitestyle.parse(pages(spark, rows)).cache()
    got = {(r.host, r.node): (r.pages, r.importance) for r in sitestyle.importance(sitestyle.features(blocks)).collect()}
    want = {(sitestyle._digest(h), b): x for (h, b), x in brute_importance(rows).items()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    low = {k for k, (m, x) in want.items() if (12 + m * x) / (12 + m) < 0.85}
    assert {tuple(r) for r in sitestyle.low_branches(blocks).collect()} == low
    of = {}
    for h, b in low:
        of.setdefault(h, set()).add(b)
    texts = {r.page_id: r.text for r in sitestyle.extract(pages(spark, rows)).collect()}
    for page_id, url, html in rows:
        assert texts[page_id] == " ".join(sitestyle.checked(sitestyle.parsed(html), of.get(sitestyle._digest(url.split("/")[2].lower()), set())))


def test_tree_removes_the_templates_of_the_table(spark):
    blocks = sitestyle.parse(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    path = lambda *names: functools.reduce(sitestyle.step, names, 0)
    templates = [path("html", "body", "div.ad"), path("html", "body", "footer"), path("html", "body", "nav", "ul", "li")]
    got = [r.node for r in sitestyle.low_branches(blocks).collect()]
    assert len(got) > 20 and set(got) == set(templates)  # and nothing of an article


HOSTILE = ['<a "', "<a ", '<a ">"', '<a b=">"', "<div>", "<ul><li>", "<table><tr><td>", "<nav>x", "<", "&", "<!--", "<script>", "</div>", "<p class", "<a '>\""]


def test_hostile_pages_take_linear_time():
    for unit in [*HOSTILE, ("<b>", "</i>"), ("<b>", "<p>"), ("<div>", "<li>"), ("<nav>", "<article>")]:
        page = lambda n: unit * (n // len(unit)) if isinstance(unit, str) else "".join(x * (n // 2 // len(x)) for x in unit)  # noqa: B023, E731
        spent = []
        for n in (1 << 16, 1 << 19):
            start = time.process_time()
            sitestyle.checked(sitestyle.parsed(page(n)), set())
            spent.append(time.process_time() - start)
        assert spent[1] < 20 * spent[0] + 0.5, unit


def test_no_rows_and_repeats(spark):
    assert sitestyle.extract(pages(spark, []).limit(0)).count() == 0
    twice = pages(spark, [(1, "http://a/", "<p>x")] * 3)
    assert [r.text for r in sitestyle.extract(twice).collect()] == ["x"] * 3


def test_generated_pages(spark, small):
    import html

    got = {r.page_id: r.text for r in sitestyle.op8_site_style_trees(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r.page_id] == " ".join(filter(None, parts))
