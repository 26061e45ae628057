"""Main text of small pages, and the tree on its own table."""

import html
import random

import pytest

from pulseloom.llm import html_text as h

LONG = "This paragraph is long enough to be taken for running text by any reader, since it goes on for quite a few words and ends late."


@pytest.fixture(scope="module")
def tree(spark):
    return h.train_tree(spark)


def test_tree_fits_its_table(tree):
    wrong = [r for r in h.LABELLED if h.classify(tree, r[:-1]) != bool(r[-1])]
    assert len(wrong) <= 3, wrong


def features(tree):
    return {tree[0]} | features(tree[2]) | features(tree[3]) if isinstance(tree, tuple) else set()


def test_neighbours_decide(tree):
    assert {h.FEATURES[k] for k in features(tree)} >= {"links", "words", "prev_links"}
    short = lambda before, behind: h.classify(tree, (*before, 3, 0.0, *behind, 0, 0, 0))
    assert not short((2, 1.0), (2, 1.0)) and not short((2, 1.0), (0, 0.0)) and short((60, 0.0), (50, 0.0)) and short((0, 0.0), (0, 0.0)) and short((3, 0.0), (3, 0.0))


def generated(rng):
    """A page without any declared furniture but bare lists of links, or with declared furniture, and its main text."""
    word = lambda: "".join(rng.choice("abcdeéß&<😀") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shown = lambda t: rng.choice(["  ", "\n", " "]).join(html.escape(t).split(" "))
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{i}'>{shown(line(rng.randint(1, 3)))}</a></li>" for i in range(rng.randint(2, 7))) + "</ul>"
    blocks = [line(rng.randint(6, 12)), *[line(rng.choice([rng.randint(25, 90), rng.randint(1, 4)])) for _ in range(rng.randint(1, 8))], line(rng.randint(25, 90))]
    body = f"<h1>{shown(blocks[0])}</h1>" + "".join(f"<{t}>{shown(b)}</{t}>" for b in blocks[1:] for t in [rng.choice(["p", "div", "blockquote"])])
    if rng.random() < 0.5:  # bare menus, a date among links, a copyright line behind the last menu
        if len(blocks[1].split()) < 25:
            return generated(rng)
        page = f"<body>{menu()}<p>{line(2)}</p>{menu()}<div>{body}</div>{menu()}<p>{shown(line(3))}</p></body>"
    else:
        ad = lambda: f"<div class='{rng.choice(['ad', 'cookie-notice', 'sidebar', 'comments', 'newsletter box'])}'><p>{shown(line(rng.randint(3, 60)))}</p></div>"
        page = f"<body><nav>{menu()}</nav>{ad()}<article>{body}{ad()}</article>{ad()}<footer>{shown(line(9))}</footer></body>"
    return page, "\n\n".join(" ".join(b.split()) for b in blocks)


def measured(tree, pages, keep):
    """Share of blocks on which the tree is right about pages of which the main blocks are known, with those declarations that ``keep`` leaves."""
    right = total = rejected = 0
    for page, want in pages:
        main, blocks = want.split("\n\n"), h.text_blocks(page)
        for b, f in zip(blocks, h.features(blocks), strict=True):
            said = h.classify(tree, (*f[:6], *[x * k for x, k in zip(f[6:], keep, strict=True)]))
            right, total, rejected = right + (said == (b.text in main)), total + 1, rejected + (not said)
    return right / total, rejected


def test_what_the_tree_decides(tree):
    rng = random.Random(11)
    pages = [generated(rng) for _ in range(300)]
    whole, rejected = measured(tree, pages, (1, 1, 1))
    assert whole > 0.999 and rejected > 1000  # nothing but scripts and unseen text is left out before the tree
    alone, _ = measured(tree, pages, (0, 0, 0))
    assert 0.75 < alone < 0.99  # word counts and link densities decide most blocks, but not all
    no_links = [(*r[:1], 0.0, r[2], 0.0, r[4], 0.0, *r[6:]) for r in h.LABELLED]
    assert sum(h.classify(tree, r[:-1]) != bool(r[-1]) for r in no_links) > 15


def test_a_declaration_alone_decides_nothing(tree):
    words = " ".join(f"w{i}" for i in range(40))
    for start in ("<div id='content' class='widget'>", "<div class='content share'>", "<div class='related'><article>"):
        assert h.main_text(f"<body><nav><a href=/>Home</a></nav>{start}<p>{words}</p></div></body>", tree) == words
        assert h.main_text(f"<body><nav><a href=/>Home</a></nav>{start}<p>two words</p></div></body>", tree) == ""


def test_generated_pages(tree):
    rng = random.Random(4)
    pages = [generated(rng) for _ in range(400)]
    wrong = [(p, w, h.main_text(p, tree)) for p, w in pages if h.main_text(p, tree) != w]
    assert not wrong, (len(wrong), wrong[0])


@pytest.mark.parametrize("page,want", [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class='ad'>{LONG}</div><article><h1>Head</h1><p><b>{LONG}<br><p>Be.</p></article><footer>&copy; me &middot; {LONG}</footer></body></html>", f"Head\n\n{LONG}\n\nBe."),
    (f"<body><header><p>Site name here</p></header><main><p>{LONG} &amp;&amp; &lt;b&gt;</p><aside>{LONG}</aside><form>{LONG}<input></form><p>two\n  words&nbsp;</p><section id=comments><p>{LONG}</p></section></main>", f"{LONG} && <b>\n\ntwo words"),
    (f"<body><div><p>{LONG}</p><p>{LONG} <a href='x>y'>more</a></p></div><script>if (a < b) document.write('<p>{LONG}</p>')</script><!-- <p>{LONG}</p> --><p>a < b stays in long text as in {LONG}</p>", f"{LONG}\n\n{LONG} more\n\na < b stays in long text as in {LONG}"),
    ("", ""), (None, ""), ("<article>", ""), ("<article><p>open <b unclosed", "open"), ('<article><p>x<a href="y>z</a> & w</p></article>', "xz & w"),
    (f"<article><div class='cookie-notice' ><p>{LONG}</p></div><p>in</p></article><div hidden>{LONG}</div>", "in"),
])
def test_pages(tree, page, want):
    assert h.main_text(page, tree) == want


def test_table(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}é😀</p></article>", 5), (2, None, None, 5), (1, "u", "<article>x", 5)], "page_id long, url string, html string, n_chars int")
    rows = h.extract_text(df).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(LONG) + 2), (2, 0), (1, 1)]
    assert h.extract_text(df.limit(0)).count() == 0
    big = "<article>" + "<p>word</p>" * 50_000 + "<" * 50_000 + '<a href="' * 3_000
    assert h.main_text(big, 1.0).startswith("word\n\nword")
