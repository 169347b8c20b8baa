import pytest

from annolytics.llm import html


def text(page):
    return " ".join(n.text for n in html.ordered(html.parse(page)) if n.tag == "text")


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><meta charset=u><body><p>seen</p></body></html>",
    "<head><title>t</title><p>seen",
    "<head><script>x</script><link rel=a><a href=b>seen</a>",
    "<head><title>t</title>seen",
    "<head><style>a</style></head><body>seen",
])
def test_head_ends_without_its_end_tag(page):
    assert text(page) == "seen"


def test_self_closed_foreign_elements_hide_nothing():
    assert text('<div><svg viewBox="0 0 1 1"/><math/>seen</div>') == "seen"
    assert text("<div><svg><g>not</g></svg>seen</div>") == "seen"


def test_place_among_many_siblings():
    nodes = html.ordered(html.parse("<div>" + "".join(f"<p>word{i}</p>" for i in range(80)) + "</div>"))
    at = html.FEATURES.index("place")
    places = [row[at] for n, row in zip(nodes, html.features(nodes), strict=True) if n.tag == "p"]
    assert places == [i / 80 for i in range(80)]


def test_pages_of_unended_tags_take_linear_time():
    import time

    for piece in ("<a ", '<a b="', "<a \"'>", "<!-- ", "<script>", "<"):
        began = time.time()
        html.parse(piece * 100_000)
        assert time.time() - began < 5, piece
    began = time.time()
    html.parse("<div>" * 20_000 + "</p>" * 100_000)
    assert time.time() - began < 5


def test_comments_without_end_are_no_text():
    leaf = lambda page: " ".join(n.text for n in html.ordered(html.parse(page)) if n.text)
    assert leaf("<p>a<!-- x") == "a" and leaf("<p>a<!-- x > y") == "a" and leaf("<p>a<!-- x --> b") == "a b"
    assert leaf("<p>a<script>b") == "a" and leaf("1 < 2") == "1 < 2" and leaf("<p>a <b") == "a <b"
