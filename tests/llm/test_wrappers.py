"""Tree matching against a plain recursion, extraction from made and from shared pages, and edge rows."""

import html
import random
import re

from billquarry.llm import queries, wrappers


def tree(chance, depth=0):
    return (chance.choice("ab"), [tree(chance, depth + 1) for _ in range(chance.randrange(4) if depth < 3 else 0)])


def plain_matching(a, b):
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i in range(1, len(a[1]) + 1):
        for j in range(1, len(b[1]) + 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_matching(a[1][i - 1], b[1][j - 1]))
    return 1 + table[-1][-1]


def shape(t):
    labels, counts = [], []

    def visit(node):
        labels.append(node[0])
        counts.append(len(node[1]))
        for c in node[1]:
            visit(c)

    visit(t)
    return wrappers.Shape(labels, counts, [0] * len(labels))


def test_matching_is_as_large_as_a_plain_one():
    chance = random.Random(1)
    for _ in range(400):
        a, b = tree(chance), tree(chance)
        x, y = shape(a), shape(b)
        pairs = wrappers.matched(x, y)
        assert len(pairs) == plain_matching(a, b) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
        assert all(x.labels[p] == y.labels[q] for p, q in pairs)


def plain_article(page):
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", found[1])]
    return "\n".join(b for b in blocks if b)


def test_shared_pages(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = queries.op4_wrapper_induction(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text)


ARTICLE = "<article class=post-body><header><h1>Title {n}</h1></header><p>First &amp; {n}<br>line\n\n two</p><aside>No</aside><ul><li>one<li>two {n}</ul><p>Shared end.</p><form><p>Name</p></form><div class='share-links'>Share</div></article>"
FULL = (
    "<html><head><title>t</title><style>x</style></head><body class='has-sidebar'><header class=site-header><p>Site</p></header><nav>Menu</nav><div id=cookie-notice>We use</div>"
    + ARTICLE
    + "<div class=sidebar><p>Side</p></div><section id=comments><p>Reader {n}</p></section><footer>Foot</footer><script>var a='<p>no</p>';</script></body></html>"
)
DIVS = "<body><div><p>Welcome to our house</p><ul><li>All the news</ul></div><div class=text><h2>Head {n}</h2><p>Body {n} a &lt; b</p><p>More{n}</p></div><div><p>Call us at noon</p></div><!-- c <p>no</p> --></body>"


def test_elements_and_wrappers(spark):
    rows = [(n, f"http://a.org/{n}", FULL.format(n=n)) for n in range(8)] + [(100 + n, f"http://b.org/{n}", DIVS.format(n=n)) for n in range(12)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c.org/", "plain &nbsp; text"), (203, "http://c.org/2", "<p>open <b>bold<p>next<script>never closed <p>x"), (204, "http://c.org/3", "<div>" * 3000 + "deep <p>one</p> two" + "</div>" * 3000)]
    rows += [(205, "http://c.org/4", "<nav>only a menu</nav>"), (None, "http://b.org/0", DIVS.format(n=0)), (100, "http://b.org/0", DIVS.format(n=0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS wrapper")
    got = {}
    for r in wrappers.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for n in range(8):
        assert got[n] == [f"Title {n}\nFirst & {n} line two\ntwo {n}"]  # what all eight articles share is template
    for n in range(1, 12):
        assert got[100 + n] == [f"Head {n}\nBody {n} a < b\nMore{n}"]
    assert got[100] == ["Head 0\nBody 0 a < b\nMore0"] * 2 and got[None] == got[100][:1]
    assert got[200] == got[201] == got[205] == [""] and got[202] == ["plain text"] and got[203] == ["open bold\nnext"]
    assert got[204][0].split() == ["deep", "one", "two"]
    assert wrappers.extract(pages.where("false")).count() == 0


def test_inline_and_unseen_elements():
    def text(page):
        return wrappers.main_text(wrappers._walk(wrappers.parse(page)), set())

    assert text("<article><p>a <span class=ad>buy <span>now</span></span>b <button>ok</button>c</p></article>") == "a b c"
    assert text("<article><p>a</p><noscript><p>turn on</p></noscript><div hidden><p>x</p></div><div style='display: none'>y</div><p>b</p></article>") == "a\nb"
    assert text("<main><p title='a > b'>x<p class='lead'>y &lt;p&gt;</main><p>out") == "x\ny <p>"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def words(chance, count):
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(6)) for _ in range(count))


def extracted(spark, pages):
    rows = [(n, url, page) for n, (url, page) in enumerate(pages)]
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_teasers_notices_small_hosts_and_layouts(spark):
    chance = random.Random(3)
    pages, expected = [], []

    def add(host, page, text):
        pages.append((f"http://{host}/{len(pages)}", page))
        expected.append(text)

    menu = "<div class=top><ul><li>Start</li><li>Shop</li></ul></div>"
    for n in range(40):  # the body stands beside a teaser
        title, body, more = words(chance, 4), words(chance, 60), words(chance, 40)
        add("teaser.org", f"<body>{menu}<article><h2>Read this too</h2></article><div class=content><h1>{title}</h1><p>{body}</p><p>{more}</p></div></body>", f"{title}\n{body}\n{more}")
    for n in range(40):  # one notice in every article, after paragraphs of any number
        body = [words(chance, 30) for _ in range(chance.randrange(1, 6))]
        page = "".join(f"<p>{b}</p>" for b in body[:-1]) + "<p>Prices hold while stocks last</p>" + f"<p>{body[-1]}</p>"
        add("notice.org", f"<body>{menu}<article>{page}</article></body>", "\n".join(body))
    for n in range(3):
        body = words(chance, 30)
        add("small.org", f"<body>{menu}<div class=x><p>{body}</p></div></body>", body)
    for layout in range(6):
        for n in range(10):
            body = words(chance, 30)
            add("layouts.org", f"<body><div class=l{layout}>{menu}</div><section class=s{layout}><p>{body}</p></section><div class=e{layout}><p>Call us</p></div></body>", body)
    repeated = words(chance, 30)
    for n in range(30):  # most pages are one page
        body = repeated if n < 22 else words(chance, 30)
        add("copies.org", f"<body>{menu}<div class=x><p>{body}</p></div></body>", body)
    first, second = words(chance, 30), words(chance, 30)
    for n in range(8):  # near copies of one article
        last = words(chance, 3)
        add("near.org", f"<body>{menu}<article><p>{first}</p><p>{second}</p><p>{last}</p></article></body>", f"{first}\n{second}\n{last}")
    for n in range(12):  # pages without a host are one host
        body = words(chance, 20)
        pages.append((None, f"<body>{menu}<div><p>{body}</p></div></body>"))
        expected.append(body)
    got = extracted(spark, pages)
    assert [got[n] for n in range(len(pages))] == expected
    assert not any("Start" in t or "stocks" in t for t in got.values())


def test_long_lists_are_matched_exactly(spark):
    chance = random.Random(5)
    for _ in range(60):  # the table in halves gives a mapping as large as the whole one
        a, b = [shape(("r", [tree(chance, 2) for _ in range(chance.randrange(1, 12))])) for _ in range(2)]
        whole, cells = wrappers.matched(a, b), wrappers.CELLS
        try:
            wrappers.CELLS = 4
            assert len(wrappers.matched(a, b)) == len(whole)
        finally:
            wrappers.CELLS = cells
    rows = [f"<li>row {n}</li>" for n in range(1500)]
    pages, bodies = [], [words(chance, 5) for _ in range(6)]
    for n, body in enumerate(bodies):
        own = [*rows[:700], *(f"<li>{body} {k}</li>" for k in range(n)), *rows[700:]]
        own[300:300] = ["<li><p>" + body + "</p></li>"]
        pages.append((f"http://long.org/{n}", f"<body><ul>{''.join(own)}</ul></body>"))
    for n, text in extracted(spark, pages).items():
        assert text.split("\n") == [bodies[n], *(f"{bodies[n]} {k}" for k in range(n))]
