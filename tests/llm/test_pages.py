import pytest
from helpers import prose

from kairoframe.llm import html_extract as H

A, B = prose(1, 40) + ".", prose(2, 30) + "."


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (None, []), ("", []), ("   ", []), ("<script>var a='<p>x</p>'</script>", []), ("just text &amp; more", ["just text & more"]),
        (f"<nav><p>{B}</p></nav><article><h1>T &eacute;</h1><p>{A}\n\t x&nbsp;y</p></article><footer>{B}</footer>", ["T é", f"{A} x y"]),
        (f"<article><p><b>{A}<br><p>{B}</article><div class='ad'>{B}</div>", [A, B]),
        (f"<body><header><h1>Site</h1></header><main><h1>T</h1><p>{A}</p><section id='comments'><p>{B}</p></section></main>", ["T", A]),
        (f"<div class='cookie-notice'>{B}</div><div id='content'><h2>T</h2><p>{A}</p><p>ok</p><div class='related'>{B}</div></div><div class='sidebar'><p>{B}</p></div>", ["T", A, "ok"]),
        (f"<article><header><h1>T</h1></header><p>{A}</p><form><p>{B}</p><input></form><aside>{B}</aside></article>", ["T", A]),
        (f"<article><ul><li>{A}<li>{B}</ul><table><tr><td>1<td>2</table></article>", [A, B, "1", "2"]),
        (f"<article><p>{A}<!-- <p>{B}</p> --></p><script>if (1<2) document.write('<p>x</p>')</script><p hidden>{B}</p>", [A]),
        (f"<nav><ul><li>{B}<article><p>{A}</p></article>", [A]),
        (f"<article><p>{A}</p><!-- open {B}", [A]),
        (f"<article><p>{A}</p></article><article><p>{B}</p></article>", [A, B]),
        (f"<article><p title='a>b \"c'>{A}</p><p>1 < 2 &am &lt;b&gt;</p></article>", [A, "1 < 2 &am <b>"]),
    ],
)
def test_main_blocks(html, expected):
    assert H.main_blocks(html) == expected


@pytest.mark.parametrize("part", ["section", "blockquote", "ul", "table"])
def test_text_around_the_heaviest_part_is_kept(part):
    row = {"ul": "li", "table": "tr"}.get(part, "p")
    html = f"<div id='text'><p>{B}</p><{part}>" + f"<{row}>{A}</{row}>" * 4 + f"</{part}><p>{B}</p></div>"
    assert H.main_blocks(html) == [B, A, A, A, A, B]


def test_doubtful_labels_go_by_their_ratios():
    html = f"<article><p>{B}</p><section class='legal-analysis'><p>{A}</p></section><div class='share'><p>Share it</p></div><p>{B}</p></article>"
    assert H.main_blocks(html) == [B, A, B]


def test_what_the_ratios_choose_decides(monkeypatch):
    html = f"<div class='a'><p>Home</p><p>News</p></div><div class='b'><p>{A}</p><p>{B}</p></div><div class='a'><p>Old</p></div>"
    assert H.main_blocks(html) == [A, B]
    monkeypatch.setattr(H, "ratios", lambda nodes: ([1.0] * len(nodes), [0.0] * len(nodes)))
    assert H.main_blocks(html) == ["Home", "News", A, B, "Old"]


@pytest.mark.parametrize(
    "html", ["<div class='a'>x y z " * 20000, "<a title=\"x " * 8000, "<p class='a\">it's " * 8000, "<![CDATA[ x " * 8000, "<p><button>" + "<blockquote>x " * 8000, "<div>" * 5000 + "</foo></section>" * 5000, "<!-- <p " * 9000, "< a <1 </ " * 9000]
)
def test_deep_and_broken_pages_take_time_and_memory_in_proportion(html):
    import time
    import tracemalloc

    def cost(part):
        tracemalloc.start()
        begin = time.process_time()
        H.main_blocks(part)
        try:
            return time.process_time() - begin, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (half_s, half_mb), (whole_s, whole_mb) = cost(html[: len(html) // 2]), cost(html)
    assert whole_s < 3.5 * half_s + 0.5 and whole_mb < 3 * half_mb + 1e6


def test_content_nodes_choose_on_every_page():
    assert H.main_blocks(f"<main><p>{A}</p><article><p>{B}</p></article><p>{A}</p></main>") == [A, B, A]
    assert H.main_blocks(f"<div><article><p>{B}</p></article><div><p>{A}</p><p>{A}</p></div></div>") == [B, A, A]
    assert H.main_blocks(f"<main><p>ok</p><article><h1>T</h1><p>{A}</p><p>{A}</p></article></main>") == ["ok", "T", A, A]
    assert H.main_blocks(f"<div id='text'><p>{A}</p><p>{A}</p></div><article><span>x</span></article><ul><li>a<li>b<li>c<li>d</ul>") == [A, A]


def test_scores_prefer_long_punctuated_paths():
    nodes = [(t, e) for t, e in H.blocks(f"<div><p>{A}</p><p>{B}</p><p>{A}</p></div><ul><li>x</li><li>y</li><li>z</li></ul>")]
    s = H.scores(nodes)
    assert min(s[:2]) > 3 * max(s[4:])


def test_table(spark):
    rows = [(1, "u", f"<article><p>{A}</p></article>"), (1, "u", f"<article><p>{A}</p></article>"), (2, None, None), (3, "v", ""), (4, "w", "<article>" + f"<p>{A}</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in H.extract(pages).collect())
    assert got == [(1, A), (1, A), (2, ""), (3, ""), (4, "\n".join([A] * 3000))]
    assert H.extract(pages.limit(0)).count() == 0
