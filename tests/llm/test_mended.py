"""Cases of earlier faults: whole-number cuts, small samples of languages, rows that share an id, deep pages."""

import random
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from trialworks.llm import html as H
from trialworks.llm.language import fit_languages
from trialworks.llm.sharding import cut_of, first_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("total", [7, 2 * 10**7, 10**12, 10**12 + 1])
def test_cuts_are_exact_at_any_size(spark, total):
    edges = sorted({min(total - 1, max(0, -(-s * total // 8) + d)) for s in range(9) for d in (-1, 0, 1)})
    df = spark.createDataFrame([(x,) for x in edges], "at long").selectExpr("at", f"{cut_of('at', 8, total)} as shard")
    df = df.selectExpr("*", f"at - {first_of('shard', 8, total)} as slot")
    for r in df.collect():
        assert (r.shard, r.slot) == (r.at * 8 // total, r.at - -(-(r.at * 8 // total) * total // 8)) and 0 <= r.shard < 8 and r.slot >= 0
    counts = [-(-(s + 1) * total // 8) - -(-s * total // 8) for s in range(8)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("n", [1, 10, 49, 50, 51])
def test_one_rule_for_samples_of_any_size(spark, n):
    draw = np.random.default_rng(5)
    parts = {"en": ["the", "and", "with", "thing", "ing", "wor"], "de": ["der", "und", "schau", "keit", "ein", "zwo"]}
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][:n]
    rows = [(i, " ".join("".join(draw.choice(parts[["en", "de"][k % 2]], 3)) for _ in range(30)), ["en", "de"][k % 2], "s", 1) for k, i in enumerate(ids)]
    model = fit_languages(spark.createDataFrame(rows, SCHEMA))
    assert (model.cut > 0.5) == (n >= 10)  # the fifth of a language sets the cut


def test_exact_stage_keeps_one_row_of_a_group(spark):
    rows = [(7, "a b", "en", "s", 1), (7, "ab", "en", "s", 2), (None, "x y", "en", "s", 3), (None, "x  y", "en", "s", 4), (None, "xy", None, "s", 5), (8, "q", "en", "s", 6), (8, "q", "en", "t", 7), (8, "r", "en", "s", 8), (None, None, None, None, 9)]
    got = P.exact_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got) == [(-1, ""), (-1, "x  y"), (7, "a b"), (8, "q"), (8, "r")]


def plain_around(page):
    """Tags and names by walking the whole stack at each block, for pages of closed and unclosed known tags."""
    stack, out, held = [], [], ""
    for tag, end, name, text in [*page, ("div", True, "", "")]:
        if held and tag not in H.INLINE:  # a block lasts until the next element that is not inline
            tags = [t for t, _ in stack if t not in H.INLINE]
            near = next((own for _, own in reversed(stack) if own), ())
            out.append((held, tuple(sorted(set(tags))), tuple(sorted({x for _, own in stack for x in own})), tuple(tags[:-3:-1]), next((t for t in reversed(tags) if t in H.PARTS), "none"), near))
            held = ""
        if end:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                if tag in H.INLINE and any(t not in H.INLINE for t, _ in stack[at:]):
                    del stack[at]
                else:
                    del stack[at:]
        else:
            if tag in H.CLOSED_BY_SELF:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (tag, "ul", "ol", "dl", "table")), None)
                if at is not None and stack[at][0] == tag:
                    del stack[at:]
            elif tag not in H.INLINE and stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((tag, (name,) if name else ()))
        held = held or text
    return out


def test_what_is_around_a_block_equals_a_walk_of_the_stack():
    rnd = random.Random(3)
    for _ in range(300):
        tags = ["div", "p", "li", "ul", "a", "b", "section", "td", "table", "span", "article"]
        page = []
        for k in range(rnd.randrange(40)):
            tag = rnd.choice(tags)
            page.append((tag, rnd.random() < 0.4, rnd.choice(["", "", "menu", "post", "side"]), "" if tag in H.INLINE else f"word{k}"))
        html = "".join((f"</{t}>" if end else f"<{t}" + (f' class="{name}"' if name else "") + ">") + text for t, end, name, text in page)
        got = [(text.split(" ")[0], *around) for text, around, _ in H.leaf_blocks(html)]
        want = plain_around([(t, end, "" if end else name, text) for t, end, name, text in page])
        assert got == want


def test_deep_pages_take_linear_time():
    known = H.trained()["known"]
    H.leaf_blocks("<div>word" * 100, known)
    took = []
    for n in (50_000, 100_000):
        began = time.time()
        blocks = H.leaf_blocks("".join(f'<div class="c{i}"><a><b>word' for i in range(n)), known)
        took.append(time.time() - began)
        assert len(blocks) == n
    assert took[1] < 8 and took[1] < 3.5 * took[0] + 0.5
    assert H.main_text("<div>word" * 100_000, H.trained()) is not None


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    page = "<html><body><article><h1>The river</h1><p>" + "The river runs through the old town, and people walk along it. " * 6 + "</p></article></body></html>"
    rows = [(1, "u", page, "x", 7), (1, "u", page, "x", 7), (None, None, None, "y", 8), (2, "v", "", "z", 9)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == 4 and got[0].text == got[1].text and "old town" in got[0].text and sorted(r.n_chars for r in got)[:2] == [0, 0]
