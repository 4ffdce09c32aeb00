import hashlib
import re
import html as H

from textloom.llm import html_main, pii

# The article of the tables' pages, by their generator's plain layout.
def article(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(t for p in parts if (t := " ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split())))


def test_pages_of_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(df).collect()}
    want = {r.page_id: article(r.html) for r in df.collect()}
    assert rows == {i: (t, len(t)) for i, t in want.items()}


def site(i, body):
    return f"<html><head><title>t{i}</title></head><body><div class='top'><a href='/'>Home</a> Our site</div><div class='content'><h2>Story {i}</h2>{body}</div><div class='legal'>All rights reserved</div></body></html>"


def test_wrapper_without_article(spark):
    rows = [(i, f"http://a.example/{i}", site(i, f"<p>Text number {i} is told here &amp; there.</p><p>More of it: {i * 7}.</p>")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_main.extract(df).collect():
        assert r.text == f"Story {r.page_id}\nText number {r.page_id} is told here & there.\nMore of it: {r.page_id * 7}."


def test_parts_that_go():
    page = """<body><header>Top</header><nav>Menu</nav><div id="cookie-notice">We use</div><main><article><header><h1>A  title</h1></header>
    <p>One<br>two <b>three</b>&nbsp;four<p>Five<ul><li>six<li>seven</ul><div class="ad">Buy</div><form><input>Ask</form>
    <script>var x="<p>no</p>"</script><table><tr><td>a<td>b</table><aside>Side</aside></article>
    <div class="comments"><article class="comment"><p>I say</p></article></div></main><footer>End</footer></body>"""
    assert html_main.main_text(page) == "A title\nOne two three four\nFive\nsix\nseven\na\nb"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://x", "plain &lt;text&gt;\n here"), (4, "http://x/", "<div>" * 5000 + "deep"), (5, "http://x/", "<p>" + "long " * 50_000), (5, "http://x/", "<p>again"), (6, "nohost", "</div></p><b>un<i>closed")]
    df = spark.createDataFrame([(*r, "h", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_main.extract(df).collect()]
    assert len(got) == 7 and (1, "", 0) in got and (2, "", 0) in got and (3, "plain <text> here", 17) in got and (4, "deep", 4) in got and (5, "again", 5) in got and (6, "unclosed", 8) in got
    assert html_main.extract(df.limit(0)).count() == 0


def test_tree_matching():
    a, b = (html_main.parse(f"<div><p>x</p><ul><li>{n}</li></ul><p>y</p></div>") for n in "12")
    n, pairs = html_main.match(a, b)
    assert n == len(pairs) == 6
    c = html_main.parse("<div><p>x</p><p>y</p></div>")
    assert html_main.match(a, c)[0] == 4


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PLAIN]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed.split(",") if listed else []) <= set(spans) and len(spans) == len(want) + r.n_added


def test_base_spans_of_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.personal_data(docs).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    assert not re.search("Python|Pandas|Arrow", pii.personal_data(docs)._jdf.queryExecution().toString())


def test_spans_of_odd_texts(frame):
    texts = {
        1: None, 2: "", 3: "😀 a@b.co_m@x.y.z, a@b@c.d e@f", 4: "1.2.3.4.5.6.7.8 300.1.1.1 01.02.003.0004 1.1.1.1", 5: "4111 1111 1111 1111 2 4111-1111-1111-1111 4111111111111111",
        6: "+1 (269) 555-3296 4524132264652876 and +49 30 1234567 x + 5", 7: "9" * 60_000, 8: "a" * 60_000 + "@", 9: "name (at) host (dot) com", 10: "+1 2 3", 11: "1 2 3 4 5 6 7 8 9 0 " * 300, 12: "x.y@" * 2000 + "z.w",
        13: "4111  1111 1111 1111 1", 14: "+" + "1 " * 20_000,
    }
    rows = pii.personal_data(frame(list(texts.items()))).collect()
    check(rows, texts)
    by = {r.doc_id: r.spans for r in rows}
    assert "phone:0:17" in by[6] and "card:18:34" in by[6] and by[9] == "email:0:24"
    assert pii.personal_data(frame([])).count() == 0


def test_trees_learn_formats(spark):
    model = pii.train(spark)
    rows = spark.createDataFrame(pii.lessons(300, seed=99), "text string, kind int, s int, e int, label int")
    from pyspark.sql import functions as F

    c = rows.select("kind", "s", "e", "label", F.explode(pii.candidates(F.col("text"))).alias("c")).where("c.k = kind AND c.s = s AND c.e = e")
    got = c.select("label", "kind", model.column(F.col("c.f")).alias("p")).collect()
    picked = [r for r in got if r.p >= model.thresholds[r.kind]]
    assert sum(r.label for r in picked) >= 0.95 * len(picked) and sum(r.label for r in picked) >= 0.9 * sum(r.label for r in got)


def test_all_articles_of_a_page(spark):
    page = lambda i: f"<body><div><article id='post-{i}'><p>First text {i}.</p></article><article id='post-{i + 1}'><p>Second, longer text {i * 3}.</p><article class='part'><p>Part {i}.</p></article></article><article class='comment'>I say</article></div></body>"
    df = spark.createDataFrame([(i, f"http://{'one' if i < 4 else f'h{i}'}.example/", page(i)) for i in range(6)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert got == {i: f"First text {i}.\nSecond, longer text {i * 3}.\nPart {i}." for i in range(6)}


def test_template_beyond_the_sample(spark):
    """A legal block after more blocks than are aligned, and two layouts on one host of which the sample sees one."""
    body = lambda i: "".join(f"<p>Text {i} {j}</p>" for j in range(100))
    flat = lambda i: f"<body>{body(i)}<p>All rights <b>reserved</b></p></body>"
    other = lambda i: f"<body><div class='wrap'><div class='story'><p>Story {i} is told at some length.</p></div><div class='fine'>Fine print of the other layout</div></div></body>"
    rows = [(i, f"http://a.example/{i}", flat(i)) for i in range(60)] + [(100 + i, f"http://a.example/o{i}", other(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(f"Text {i} {j}" for j in range(100)) for i in range(60))
    assert [got[100 + i] for i in range(4)] == [f"Story {i} is told at some length." for i in range(4)]


def test_template_within_article(spark):
    page = lambda i: f"<body><main><p>Get our letter <a href='/'>here</a></p><article><h1>Title {i}</h1><p>Note: <b>text {i}</b></p><p>Same on some {i % 2}</p><div>All rights reserved</div></article></main></body>"
    df = spark.createDataFrame([(i, f"http://{'many' if i < 12 else 'few'}.example/", page(i)) for i in range(15)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert [got[i] for i in range(12)] == [f"Title {i}\nNote: text {i}\nSame on some {i % 2}" for i in range(12)]
    assert all(got[i].endswith("All rights reserved") for i in (12, 13, 14))  # too few pages to tell


def test_all_pages_make_the_wrapper(spark, monkeypatch):
    """What eight pages of a host share, those with the smallest hashes of page_id, is no template if the other pages have something else there; whatever is broadcast."""
    from pyspark.sql import functions as F

    few = {r.id for r in spark.range(60).orderBy(F.xxhash64("id")).limit(8).collect()}
    page = lambda i: f"<body><div class='content'><p class='note'>{'Sold out today' if i in few else f'Note {i}'}</p><p>Text {i} is told here.</p></div><div class='legal'>All rights reserved</div></body>"
    df = spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(60)], "page_id long, url string, html string")
    want = {i: f"{'Sold out today' if i in few else f'Note {i}'}\nText {i} is told here." for i in range(60)}
    assert {r.page_id: r.text for r in html_main.extract(df).collect()} == want
    monkeypatch.setattr(html_main, "HELD_BYTES", -1)
    assert {r.page_id: r.text for r in html_main.extract(df).collect()} == want


def test_alignment_counts_all_text():
    """Each character of a page counts once, at the node of the reference that has it or stands above it."""
    ref = html_main.Reference("<div><p>a</p><p>same</p></div>")
    got = [(x >> 33, x >> 32 & 1, x & 0xFFFFFFFF) for x in html_main.align(ref, html_main.parse("<div><p>xyz</p><p>same</p><ul><li>four</li></ul></div>"))]
    assert sorted(got) == [(0, 1, 0), (1, 1, 4), (2, 0, 3), (3, 1, 4)]
    assert html_main.learn("<div><p>a</p></div>", [[0, 1, 1, 0]]) == {"root": None, "template": []}


def test_all_children_are_aligned_at_any_depth(spark):
    """Template behind hundreds of siblings, or below dozens of levels, which most of a host's pages have but not all, so that no count of blocks tells it."""
    legal = lambda i: "<div class='legal'>All rights reserved</div>" if i % 5 else ""
    story = lambda i, n: "".join(f"<p>Part {k} of {i}</p>" for k in range(n))
    flat = lambda i: f"<body><div class='content'>{story(i, 90 + 7 * i)}{legal(i)}</div></body>"
    deep = lambda i: f"<body>{'<div class=level>' * 120}{story(i, 3)}{legal(i)}{'</div>' * 120}</body>"
    df = spark.createDataFrame([(k * 20 + i, f"http://{host}.example/{i}", page(i)) for k, (host, page) in enumerate((("flat", flat), ("deep", deep))) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert got == {k * 20 + i: "\n".join(f"Part {p} of {i}" for p in range(3 if k else 90 + 7 * i)) for k in (0, 1) for i in range(20)}


def most(a, b):
    """Simple tree matching by its recurrence."""
    if a.key != b.key:
        return 0
    x, y = ([n for n in t.items if not isinstance(n, str)] for t in (a, b))
    M = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, n in enumerate(x):
        for j, m in enumerate(y):
            M[i + 1][j + 1] = max(M[i][j + 1], M[i + 1][j], M[i][j] + most(n, m))
    return M[-1][-1] + 1


def test_tree_matching_is_whole():
    import random

    r = random.Random(5)
    tree = lambda d: r.choice(("<p>x</p>", "<b>x</b>")) if not d else f"<{(t := r.choice(('div', 'ul')))}>{''.join(tree(r.randint(0, d - 1)) for _ in range(r.choice((2, 5, 40))))}</{t}>"
    for pages in ((tree(r.randint(1, 3)), tree(r.randint(1, 3))) for _ in range(40)):
        a, b = map(html_main.parse, pages)
        n, pairs = html_main.match(a, b)
        assert n == len(pairs) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == most(a, b) and all(x.key == y.key for x, y in pairs)
    for one, other, want in (("<p></p>" * 300, "<p></p>" * 400, 301), ("<p></p><b></b>" * 200 + "<i></i>", "<b></b>" * 150 + "<i></i>", 152), ("<div>" * 3000 + "<p>", "<div>" * 2500 + "<p>", 2501)):
        assert html_main.match(html_main.parse(one), html_main.parse(other))[0] == want
