"""Decontamination, chat formatting and main text against plain Python."""

import html
import re

import pytest

from webtables.llm import chat, decontaminate, wrappers
from webtables.llm.common import table


def plain_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    words = word.findall((text or "").translate(lower))
    hit, found = set(), set()
    for item, said in items:
        ws = word.findall((said or "").translate(lower))
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == ws[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(words), len(hit), sorted(found)


ITEMS = [("1", "a b c d e f g h i j k l"), ("2", "Short one"), ("10", "Über uns, 3"), ("3", None), ("4", "..."), ("5", "short one"), ("6", "j k l a b c d e f g")]
TEXTS = [None, "", "A b c d e f g h i j k l a b c d e f g", "x SHORT-one short one y", "über uns 3 Über uns 3", "one short", "a b c d e f g h i", "short one " * 20_000]


@pytest.mark.parametrize("block", [1, 30, 1 << 20])
def test_hits(spark, block):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(int(i), t) for i, t in ITEMS], "item_id long, text string")
    for row in decontaminate.hits(docs, bench, block_bytes=block).collect():
        hit = sum(r["last"] - r["first"] + 1 for r in row.ranges)
        if row.doc_id < 7:
            assert (row.n_words, hit, row["items"]) == plain_hits(TEXTS[row.doc_id], ITEMS)
        else:
            assert (row.n_words, hit, row["items"]) == (40_000, 40_000, ["2", "5"])


def test_spans_in_the_original(spark):
    docs = spark.createDataFrame([(1, "äh: the SHORT,  One! end")], "doc_id long, text string")
    bench = spark.createDataFrame([(2, "short one")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.spans(docs, bench).collect()] == [(1, 8, 19, "SHORT,  One")]


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.report(docs, none).collect()] == [False, False]
    assert decontaminate.report(docs.limit(0), none).count() == 0
    assert decontaminate.clean(docs, none).count() == 2


def plain_chat(rows):
    logs = {}
    for conv, *turn in rows:
        logs.setdefault(conv, []).append(turn)
    key = lambda t: tuple((v is not None, v or "" if not isinstance(v, int) else v) for v in t)
    logs = {c: [tuple(t[1:]) for t in sorted(ts, key=key)] for c, ts in logs.items()}
    rank = lambda c: (c is None, c or 0)
    kept = {}
    for c, ts in logs.items():
        longer = any(o != c and len(u) > len(ts) and u[: len(ts)] == ts for o, u in logs.items())
        same = any(o != c and u == ts and rank(o) < rank(c) for o, u in logs.items())
        if not longer and not same:
            kept[c] = "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in ts)
    return kept


def test_chat(spark):
    said = lambda c, *ts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ts)]
    rows = said(1, "a", "b") + said(2, "a", "b", "c") + said(3, "a", "b", "c") + said(4, "a", None) + said(5, "a", "") + said(6, "x")
    rows += said(7, *["t"] * 300) + said(8, *["t"] * 150) + [(9, None, None, None), (None, 0, "user", "a"), (10, 1, "user", "r"), (10, 1, "user", "r")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    parts = sorted(chat.rendered(frame).collect(), key=lambda r: (r.conv_id or 0, r.part))
    found = {}
    for r in parts:
        found[r.conv_id] = found.get(r.conv_id, "") + r.text
    assert found == plain_chat(rows)
    assert max(r.part for r in parts) == 4
    assert chat.rendered(frame.limit(0)).count() == 0


def test_articles_of_pages(spark):
    rows = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    for r in wrappers.extract(table(spark, "/root/testdata/sf0.01", "pages")).collect():
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body><header><p>Site</p></header><div class="cookie-notice">We use</div>'
    "<ul><li><a href=x>m1</a><li><a>m2</a></ul><div id=content>{}<h1>T&eacute;st &#39;x&#39; &amp;lt;</h1><p>One <b>two</b>three<br>four<p>Five"
    '<div class="ad-slot">buy</div><!-- <p>no</p> --><script>"<p>no</p>"</script><table><tr><td>c1<td>c2</table>'
    '<section class="comments"><p>c</p><p>c</p></section><ul><li>i1</li><li>i2 <a href="q">x</a></li></ul><form><p>mail</p></form>{}</div>'
    "<aside><p>s</p></aside><footer>f</footer></body></html>"
)
TEXT = "Tést 'x' &lt;\n\nOne twothree four\n\nFive\n\nc1\n\nc2\n\ni1\n\ni2 x"


@pytest.mark.parametrize("tags", [("<main>", "</main>"), ("<article>", "</article>"), ("", "")])
def test_boilerplate_is_left_out(spark, tags):

    page = PAGE.replace("p{}", "p").replace("{}", "%s") % tags
    pages = spark.createDataFrame([(1, "http://a.b/c", page, 0), (2, "http://a.b/d", page, 0), (3, None, page, 0)], "page_id long, url string, html string, text int")
    assert {r.text for r in wrappers.extract(pages).collect()} == {TEXT}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (3, "http://h/x", "plain & simple"), (4, "http://h/y", "<p>un<b>closed"), (5, "http://h/z", deep), (None, "http://h/z", "<a href='x>broken"), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.text) for r in wrappers.extract(pages).collect())
    assert [f for f in found if f[0]] == [(1, ""), (2, ""), (2, ""), (3, "plain & simple"), (4, "unclosed"), (5, "deep")]
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_large_hosts_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP", 3)
    rows = [(i, "http://h/x", "<main><p>a</p>" + "<h2>b</h2>" * (i % 3) + "<ul><li>c</li></ul>" * (i % 5) + f"</main>{'<table><tr><td>t</table>' * (i % 7)}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert wrappers.infer(wrappers.with_host(pages)).count() == 1
    for r in wrappers.extract(pages).collect():
        assert r.text == "\n\n".join(["a"] + ["b"] * (r.page_id % 3) + ["c"] * (r.page_id % 5))


def texts(spark, *rows):
    """The main text of every (url, html), in order."""
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in sorted(wrappers.extract(pages).collect(), key=lambda r: r.page_id)]


def test_templates_of_a_host_are_told_apart(spark):
    """Only some pages have article or main; pages without a host mix templates."""
    first, second = "<p>out</p><article><p>one</p></article>", "<div id=content><p>two</p></div>"
    teasers = "<div><article><p>card</p></article><article><p>more</p></article></div>"
    rows = [(url, page) for url in ("http://h/x", None, "/rel") for page in (first, second, teasers)]
    assert texts(spark, *rows) == ["one", "two", "card\n\nmore"] * 3


def test_deep_elements_close_and_leave_out(spark):
    """Elements opened below DEPTH end with their own tags, and still count as what they are."""
    many = 70 * "<div>", 70 * "</div>"
    after = "<div id=page><main>{}<p>deep</p>{}<p>after</p></main><p>out</p></div>".format(*many)
    nav = "{}<nav>menu<div>menu</div></nav><form><p>form</p></form><p>deep</p>{}<p>after</p>".format(*many)
    main = "{}<main><p>deep</p></main><p>out</p>{}<p>out</p>".format(*many)
    flat = "<div>x" * 20_000
    found = texts(spark, ("http://h/x", after), ("http://h/x", nav), ("http://h/x", main), ("http://i/x", flat))
    assert found == ["deep\n\nafter", "deep\n\nafter", "deep", "\n\n".join("x" * 20_000)]


@pytest.mark.parametrize(
    "page",
    [
        "<article><section id=discussion><h2 id=related-work>A</h2><p>B</p></section></article>",
        "<article class='post category-social'><p>A</p><p>B</p></article>",
        "<article class='post comments-open comments'><header class=entry-header><h1>A</h1></header><p>B</p></article>",
        "<article><div class=header><h1>A</h1></div><p>B</p></article>",
        "<div class='content with-sidebar'><h1 class=header>A</h1><p>B</p></div><div class='sidebar no-sidebar'>s</div>",
        "<div class='no-sidebar'><p>A</p><section id=search><p>B</p></section></div><div class=site-footer>f</div>",
        "<form><h1>A</h1><p>B</p><div class=comment-list><p>longer than A and B</p></div></form>",
        "<div class=sidebar><h1>A</h1><p>B</p></div>",
        "<div title='the hidden cost'><p data-x=hidden>A</p></div><p style='overflow: hidden !important'>B</p><p hidden>c</p>",
        "<p class='not hidden'>A</p><p>B</p><p style='color:red;display :none'>c</p><p aria-hidden=true>c</p><div HIDDEN=''>c</div>",
        "<p>A</p><p>B</p><div class=ad-slot-2>c</div><div id=cookie_banner>c</div><div role=search>c</div><div class='x related-posts'>c</div>",
    ],
)
def test_names_leave_out_no_more_than_they_say(page):
    assert wrappers.main_text(page, wrappers.menus(wrappers.read(page))) == "A\n\nB"


def test_texts_constant_over_a_host_are_left_out(spark):
    """Outside article and main; neither captures of one url nor copies of a page count twice."""
    page = "<div>We use c.</div><div><p>T{0}</p><p>Same</p></div><div>By us</div>"
    rows = [(f"http://h/{i}", page.format(i)) for i in range(4)] + [("http://h/9", "<div><p>Same</p></div><p>By us</p>")]
    assert texts(spark, *rows) == ["T0", "T1", "T2", "T3", "By us"]
    once = [("http://h/x", page.format(i)) for i in range(4)] + [(f"http://i/{i}", page.format(0)) for i in range(4)]
    assert texts(spark, *once) == [f"We use c.\n\nT{i}\n\nSame\n\nBy us" for i in (0, 1, 2, 3, 0, 0, 0, 0)]
    few = [(f"http://h/{i}", "<p>Odd</p>" * (i < 3) + f"<p>p{i}</p>") for i in range(6)]
    assert texts(spark, *few) == ["Odd\n\np0", "Odd\n\np1", "Odd\n\np2", "p3", "p4", "p5"]
    inside = [(f"http://h/{i}", f"<main><p>Same</p><p>T{i}</p></main>") for i in range(4)]
    assert texts(spark, *inside) == [f"Same\n\nT{i}" for i in range(4)]


def test_lists_of_links_are_menus_only_if_they_recur(spark):
    """A menu and an article's references share their path; some entries differ."""
    menu = [f"<li><a>m{k}</a></li>" for k in range(5)]
    page = "<body><ul>{}</ul><p>T{}</p><ul>{}</ul></body>"
    refs = [[f"r{i}", f"q{i}", "shared"] for i in range(4)]
    rows = [
        (f"http://h/{i}", page.format("".join(menu[:i] + menu[i + 1 :]), i, "".join(f"<li><a>{r}</a></li>" for r in refs[i])))
        for i in range(4)
    ]
    assert texts(spark, *rows) == ["\n\n".join([f"T{i}", *refs[i]]) for i in range(4)]
    assert texts(spark, rows[0]) == ["T0\n\nr0\n\nq0\n\nshared"]
