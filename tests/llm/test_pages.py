"""Page differencing: hand-made pages, alignment against a plain table, ranges against one sorted list."""

import random

import pytest

from tenderloom.llm import pages


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        mask = pages.shared_lines(a, b)
        taken = [x for x, m in zip(a, mask, strict=True) if m]
        assert len(taken) == plain_lcs(a, b)
        it = iter(b)
        assert all(x in it for x in taken)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad 0 --><div class="ad">buy</div><div class="top-banner">sale</div>
<header><h1>Site</h1></header><article class="post"><header><h1>Head&#8217;s &lt;b&gt;</h1></header><p><b>One
 two<br><p>three <i>fo</i>ur&nbsp;five</p><aside>side</aside><form>f<input></form><ul><li>a<li>b</ul><div id="comments"><p>nice!</p></div></article>
<section class="comments"><article class="comment">me too</article></section><footer>&copy; x</footer>"""


def test_markup_rules():
    assert pages.main_text(pages.blocks(PAGE), None) == ("Head’s <b> One two three four five a b", 0)
    assert pages.main_text(pages.blocks(None), None) == ("", 0)
    assert pages.main_text(pages.blocks("just text &amp; more"), None) == ("just text & more", 0)
    assert pages.main_text(pages.blocks("<p>a<nav>menu<p>b</nav><p>c<script>never closed"), None)[0] == "a c"
    assert pages.main_text(pages.blocks('<form id="whole"><main><p>kept</p></main></form>'), None)[0] == "kept"


def sample():
    rng = random.Random(8)
    out = []
    for h in range(4):
        frame = [f"site {h} line {k}" for k in range(4)]
        for p in range(rng.choice([1, 2, 9, 40])):
            own = [f"own {h} {p} {k}" for k in range(rng.randrange(1, 5))]
            lines = frame[:2] + own + frame[2:]
            out.append((f"http://Host{h}.example/{rng.choice('ab')}/{p}?q={p}#x", "".join(f"<div>{x}</div>" for x in lines), own))
    out += [(None, "<p>no url</p>", ["no url"]), (None, "<p>no url</p>", ["no url"]), ("", None, []), ("/relative", "<p>r", ["r"])]
    return [(i, *x) for i, x in enumerate(out)]


SCHEMA = "page_id long, url string, html string, host string, text int"


def test_shared_frames_go(spark):
    rows = sample()
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in rows], SCHEMA).repartition(3)
    got = {r.page_id: r for r in pages.main_texts(df).collect()}
    count = {}
    for i, u, _, _ in rows:
        count[u.split("/")[2] if u and "//" in u else None] = count.get(u.split("/")[2] if u and "//" in u else None, 0) + 1
    assert len(got) == len(rows)
    for i, u, h, own in rows:
        alone = not u or "//" not in u or count[u.split("/")[2]] == 1
        r = got[i]
        assert r.url == u and r.n_chars == len(r.text)
        assert r.text == (" ".join(t for t, _, _ in pages.blocks(h)) if alone else " ".join(own))


def test_partner_does_not_hang_on_ranges(spark):
    rows = [(i, u, h) for i, u, h, _ in sample()]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = None
    for n in ("1", "3", "40"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((r.page_id, r.partner_id, r.text) for r in pages.main_texts(df).collect())
        spark.conf.set("spark.sql.shuffle.partitions", old)
        want = want or got
        assert got == want


def test_copies_keep_their_text_and_empty_table(spark):
    copy = "<p>one</p><p>two</p><p>three</p>"
    df = spark.createDataFrame([(1, "http://h/a", copy, "", 0), (2, "http://h/a?x", copy, "", 0), (2, "http://h/a?x", copy, "", 0)], SCHEMA)
    assert [r.text for r in pages.main_texts(df).collect()] == ["one two three"] * 3
    assert pages.main_texts(df.limit(0)).collect() == []


def cut(page, partner=None):
    return pages.main_text(pages.blocks(page), pages.blocks(partner) if partner else None)


def test_differencing_runs_inside_main():
    menu = "<div>Teaser one</div><ul><li><a href=x>Menu</a></li></ul>"
    page, other = (f"<body><div>Frame</div><main>{menu}<p>Same opening.</p><p>Own text {k} of this page.</p></main><div>Only {k}</div></body>" for k in "ab")
    assert cut(page, other) == ("Same opening. Own text a of this page. Only a", 3)


def test_nested_articles_stay_unwanted():
    assert cut("<article><p>Text.</p><section class=comments><article id=c1>me too</article></section></article>")[0] == "Text."
    assert cut("<div class=post>Real text.</div><aside><article>teaser</article></aside>")[0] == "Real text."
    assert cut("<nav><article>menu</article></nav><footer><article>foot</article></footer><form><article>kept</article></form>")[0] == "kept"


def test_article_parts_are_not_dropped_by_pieces_of_names():
    page = """<article><h2 id=related-work>Related work</h2><section id=social-impact>Impact.</section><div class="search-results-discussion">Talk.</div>
        <p id="notice">Note.</p><span title='a hidden gem'>Gem.</span> <span data-1="x hidden y">Data.</span><p hidden>no</p><div class="post share">no</div></article>"""
    assert cut(page)[0] == "Related work Impact. Talk. Note. Gem. Data."


@pytest.mark.parametrize("copies", [2, 60])
def test_copies_are_cut_by_another_page(spark, copies):
    def page(own):
        return f"<div>menu one</div><div>menu two</div><div>{own}</div><div>all rights reserved</div>"

    rows = [(0, "http://h/news/0", page("the first story of this site, long enough")), (900, "http://h/news/9", page("another story here, also long enough"))]
    rows += [(i, f"http://h/news/5?utm={i}" if i % 2 else "http://h/news/5", page("a story that was fetched again and again")) for i in range(1, copies + 1)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    for n in ("1", "3", "40"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: (r.text, r.partner_id, r.n_deleted) for r in pages.main_texts(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert got[1] == ("a story that was fetched again and again", 0, 3)
        assert {got[i] for i in range(1, copies + 1)} == {got[1]}


@pytest.mark.parametrize("box", ["<section class='comment-list'>{}</section>", "<div id=comments-area>{}</div>", "<div class='ad-slot x'>{}</div>", "<ul class=related-posts>{}</ul>",
                                 "<div class=reply>{}</div>", "<aside class='share-buttons'>{}</aside>", "<div class=comments_section><h2 class=comments-title>Comments</h2>{}</div>", "<div id=ad-2>{}</div>"])
def test_boxes_inside_the_article_that_are_no_part_of_it(box):
    inner = box.format("<li>Not the article</li>")
    partner = "<main><p>Another text altogether.</p></main>"
    assert cut(f"<main><p>Own text one.</p>{inner}<p>Own text two.</p></main>", partner)[0] == "Own text one. Own text two."
    assert cut(f"<article><p>Own text one.</p>{inner}</article>")[0] == "Own text one."


@pytest.mark.parametrize("box", ["<section id=related-work>{}</section>", "<div class='comment-on-the-law'>{}</div>", "<div class=advertising-history>{}</div>", "<section class='reply-to-critics'>{}</section>",
                                 "<p class=comment-list>{}</p>", "<h2 id=comments-section>{}</h2>", "<blockquote class=share-box>{}</blockquote>"])
def test_boxes_inside_the_article_that_are_its_own(box):
    assert cut(f"<article><p>Own text one.</p>{box.format('Kept.')}</article>")[0] == "Own text one. Kept."
