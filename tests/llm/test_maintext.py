"""Main text: pages of many kinds, the linear scan against all runs, and edge cases."""

import itertools
import random
import time

import pytest

from docsluice.llm import maintext as m

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string"

ARTICLE = "<h1>Old mill &amp; pond</h1><p>The mill was\n built   in 1820 by two brothers.</p><p>It burnt <b>twice</b>, and was <a href=x>rebuilt</a> each time.<p>Now it is closed."
EXPECTED = "Old mill & pond\nThe mill was built in 1820 by two brothers.\nIt burnt twice, and was rebuilt each time.\nNow it is closed."
NOISE = (
    "<header><h2>The Daily Site</h2><p>News for all who read it every day.</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>All about us</a></ul></nav>"
    "<div class='cookie-notice'><p>We use cookies to make this site better for you.</p><button>Accept all</button></div><!-- <p>old text that was here</p> --><script>if (a < b) { w('<p>no</p>') }</script>"
)
AFTER = (
    "<aside><h3>More to read</h3><p>Ten mills you should see this summer.</p></aside><section id=comments><h2>Comments</h2><article class=comment><p>What a fine story this is, thank you so much.</p></article>"
    "<article><p>My grandfather worked in that mill for years.</p></article></section><form><label>Your mail</label><input><textarea>Write here</textarea></form><footer>&copy; 2024 The Daily Site. All rights reserved.</footer>"
)


@pytest.fixture(scope="module")
def weights():
    return m.weights_of(m.sample_counts())


def samples():
    return [
        (f"<html><head><title>t</title><style>p{{}}</style></head><body>{NOISE}<article>{ARTICLE}</article>{AFTER}</body></html>", EXPECTED),
        (f"<body>{NOISE}<main><div class=left>{ARTICLE}</div></main>{AFTER}", EXPECTED),
        (f"<body>{NOISE}<div class=wrap><div>{ARTICLE}</div></div>{AFTER}</body>", EXPECTED),
        (f"{NOISE}<div class='content with-sidebar'><article>{ARTICLE}</article></div>{AFTER}", EXPECTED),
        (f"{NOISE}<div class='page-sidebar-layout'><article>{ARTICLE}</article></div>{AFTER}", EXPECTED),
        (f"<form id=aspnet>{NOISE}<article>{ARTICLE}</article></form>", EXPECTED),
        (f"<article>{ARTICLE}<div class=ad><p>Buy two lamps and get one more for free today.</p></div><p>The pond stays.</p></article>", EXPECTED + "\nThe pond stays."),
        (f"<article><header>{ARTICLE}</header><div class='share-buttons'>Share this story</div><footer>By A. Writer</footer></article>", EXPECTED),
        (f"<article>{ARTICLE}<div hidden>Hidden words that nobody sees at all.</div><div style='display: none'>And more hidden words here.</div></article>", EXPECTED),
        (f"<div role=banner>The name of the site stands here.</div><article>{ARTICLE}</article><div role='contentinfo'>Address of the site in town.</div>", EXPECTED),
        ("<article><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table>x<br>y<hr>z&nbsp;&#8212;&#x41;</article>", "One\nTwo\na\nb\nx y\nz —A"),
        ("<article>a < b and <3 <p title='>'>c</p><p title=it's>d</p></article>", "a < b and <3\nc\nd"),
        ("<article>un<b>brok</b>en <i>word</i><script>x</script>s</article>", "unbroken words"),
        ("<article>word</article>", "word"),
        ("<article>kept <!-- open comment", "kept"),
        ("<article>kept <p title=\"open", "kept"),
        ("<article>&#0;&#xD800;&#99999999999;&#x110000;&unknown; &ampx &am</article>", "����&unknown; &x &am"),
        ("", ""),
        (None, ""),
        ("<nav>Only a menu</nav><script>x</script>", ""),
        (" \n\t ", ""),
        ("<div class=comments>Nothing but this text, in which every word is named a comment.</div>", "Nothing but this text, in which every word is named a comment."),
        ("Plain text without any markup at all.", "Plain text without any markup at all."),
    ]


@pytest.mark.parametrize("i", range(len(samples())))
def test_pages_of_many_kinds(weights, i):
    html, text = samples()[i]
    assert m.extract(html, weights) == text


def test_labelled_samples(weights):
    for s in m.SAMPLES:
        a, z = s.index("{{"), s.index("}}")
        html = s.replace("{{", "").replace("}}", "")
        page = m.Page(html)
        assert m.extract(html, weights) == page.text({b for _, b, _, at in page.tokens if b >= 0 and a <= at < z - 2})


def test_best_run_equals_all_runs():
    r = random.Random(3)
    for _ in range(300):
        s = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(r.randint(0, 12))]
        a, z = m.best_run(s)
        assert sum(s[a:z]) == max([0, *(sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2))])


def test_weights_come_from_labelled_pages(spark):
    rows = [(f"<body><div class=x><p>{'menu words here ' * 5}</p></div><div>{{{{<blockquote>{'the story goes on ' * 9}.</blockquote>}}}}</div></body>") for _ in range(4)]
    df = spark.createDataFrame([(s.replace("{{", "").replace("}}", ""), s.index("{{"), s.index("}}") - 2) for s in rows] + [(None, 0, 5), ("<p>no label</p>", None, None)], "html string, a int, z int")
    own = m.fit(df, start="a", end="z")
    before = m.weights_of(m.sample_counts())
    assert own["free li text"] == before["free li text"] and own["free p text"] < before["free p text"]
    marked = m.fit(spark.createDataFrame([(f"<div>Some line outside of it.</div><article>{ARTICLE}</article>",)] * 3, "html string").repartition(2))
    assert marked["in p text"] > 1 and marked["out div text"] < -1 and all(v < 0 for k, v in marked.items() if k.endswith(">"))


def test_rows_are_kept(spark):
    rows = [(i, f"u{i}", h, "old", "other") for i, (h, _) in enumerate(samples())]
    rows += [(0, None, rows[0][2], None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, m.page_texts(df).collect()), key=str)
    want = [(i, u, t, len(t)) for i, u, t in [(r[0], r[1], samples()[r[0]][1] if r[0] is not None else "") for r in rows]]
    assert got == sorted(want, key=str)
    added = m.main_text(df, m.weights_of(m.sample_counts()))
    assert added.columns == ["page_id", "url", "html", "text", "n_chars", "text_", "n_chars_"] and {r["text"] for r in added.collect()} == {"old", None}
    assert m.page_texts(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<script>" * 100_000, '<a b="' * 100_000, "<a b='x" * 100_000, "<!--" * 200_000, "<" * 500_000, "<p>a" * 60_000, "<ul><li>" * 50_000, "&" * 500_000, "<a " + " " * 500_000, "<a " + "x= " * 200_000, '<p class="' + "a-" * 200_000 + '">x', "</p>" * 100_000, "&#" + "1" * 300_000, "word " * 300_000],
)
def test_long_pages_take_linear_time(weights, html):
    t = time.process_time()
    m.extract(html, weights)
    assert time.process_time() - t < 8
