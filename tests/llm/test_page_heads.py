import pytest

from trialworks.llm.html import leaf_blocks, main_text, trained

PROSE = "It rained for most of the day, and the river rose. People moved their boats to the upper quay before dark, as they do each spring."
ARTICLE = f"<article><h1>The river</h1><p>{PROSE}</p><p>{PROSE}</p></article>"
HEAD = "<head><meta charset=utf-8><title>t</title><style>p {}</style><script>var a = '<p>';</script>"


@pytest.mark.parametrize("page", [
    f"<html>{HEAD}</head><body>{ARTICLE}</body></html>",
    f"<html>{HEAD}<body>{ARTICLE}</body></html>",
    f"<html>{HEAD}{ARTICLE}</html>",
    f"<html>{HEAD}\n  <body class=x>\n{ARTICLE}",
    f"<!doctype html>{HEAD}</head>{ARTICLE}",
])
def test_pages_may_leave_out_the_end_of_the_head_and_the_body(page):
    assert [b[0] for b in leaf_blocks(page)] == ["The river", PROSE, PROSE]
    assert PROSE in main_text(page, trained())


def test_text_ends_a_head_and_head_text_stays_unseen():
    assert [b[0] for b in leaf_blocks("<head><title>t</title>\n Some text <b>here</b>.<p>More")] == ["Some text here.", "More"]
    assert leaf_blocks("<html><head><title>t</title> <meta name=a></head><body></body>") == []
    assert [b[0] for b in leaf_blocks("<head><title>t</title><b>bold</b> text")] == ["bold text"]
    assert [b[0] for b in leaf_blocks("<body><svg><title>no</title><text>no</text></svg><p>yes")] == ["yes"]


def test_all_class_names_of_an_element_count():
    names = "flex grow shrink basis wrap mx px py bg text sidebar"
    (block,) = leaf_blocks(f'<div class="{names}" id="comments">word</div>')
    assert set(names.split()) | {"comments"} <= set(block[1][1]) and block[1][4][-2:] == ("sidebar", "comments")


@pytest.mark.parametrize("tag", ['<p class=a">', "<p title=don't>", '<p class="a"b">', "<p data-x=it's\">", '<p title="a > b">', "<p x='1>2'>", '<p title="never closed>', "<p 'odd \" quotes>", "<p a= \"b\" c = 'd'>"])
def test_stray_quotes_lose_no_text(tag):
    page = f"<article><h1>The river</h1>{tag}{PROSE}</p><p>{PROSE}</p></article>"
    assert [b[0] for b in leaf_blocks(page)] == ["The river", PROSE, PROSE]
    assert main_text(page, trained()).count(PROSE) == 2
