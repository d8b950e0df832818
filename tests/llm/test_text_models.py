import re
from collections import Counter

import numpy as np
import pytest

from trialworks.llm import html as H
from trialworks.llm.language import identify_languages, remainder
from trialworks.llm.quality import WordCodes, base_counts, judge, repeated_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, n_words long"


def brute_base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    mark = {i + k for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(mark)


def test_base_counts_against_brute_force():
    rng = np.random.default_rng(3)
    codes = WordCodes()
    texts = ["", None, "a b c", "a b c a b c", "\n\n", " a\na\n a\n\x0b\n", "é é #*", "x " * 500] + ["".join(rng.choice(list("ab \n\t#é"), 60)) for _ in range(800)]
    assert [base_counts(t, codes) for t in texts] == [brute_base(t) for t in texts]
    big = WordCodes({str(i).encode(): i for i in range((1 << 20))})
    assert repeated_words([b"p", b"q", b"r", b"p", b"q", b"r"], big) == 6


def corpus(n=300):
    rng = np.random.default_rng(4)
    words = {"en": ["the", "and", "with", "thing", "ing"], "de": ["der", "und", "schau", "keit", "ein"], "fr": ["les", "que", "eau", "une", "tion"], "es": ["los", "que", "ción", "una", "para"]}
    out = []
    for i in range(n):
        lang = ["en", "de", "fr", "es"][i % 4]
        t = " ".join("".join(rng.choice(words[lang], rng.integers(1, 4))) for _ in range(rng.integers(80, 200)))
        bad = i % 5 == 0
        out.append((i, re.sub(r"(\w) ", r"\1%%% ", t) if bad else t, lang, "s", 1, None, None, None))
    return out


def extra():
    return [(900, None, "en", None, None, None, None, None), (901, "", "en", None, None, None, None, None), (902, "1234 ++", None, "s", 1, None, None, None),
            (None, "the thing and", "en", "s", 1, None, None, None), (5, "the thing and", "en", "s", 1, None, None, None), (903, "und der " * 40_000, None, "s", 1, None, None, None)]


def test_quality_keeps_trusted_and_drops_bad(spark):
    rows = corpus() + extra()
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 300, 3)] + [(None, 1, 0), (4, None, 0)]
    got = judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None and g.doc_id < 300 and g.n_words > 3:
            assert g.kept == (g.doc_id % 5 != 0) and not g.base_failed
        else:
            assert g.base_failed and not g.kept
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(g.kept != g.base_failed for g in judge(spark.createDataFrame(rows, SCHEMA), no_labels).collect())
    assert judge(spark.createDataFrame([], SCHEMA), no_labels).collect() == []


def test_languages_on_held_out_documents(spark):
    rows = corpus(400) + extra()
    got = identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 400 and r[0] != 5}
    assert all(g.held_out == (g.doc_id is not None and remainder(g.doc_id) == 2) and 0 <= g.score <= 1 for g in got)
    held = [g.lang_pred == lang[g.doc_id] for g in got if g.held_out and g.doc_id in lang]
    assert len(held) > 60 and np.mean(held) > 0.97
    by = {g.doc_id: g.lang_pred for g in got}
    assert by[900] == by[901] == by[902] == "und" and by[903] == "de"
    blank = spark.createDataFrame([(1, "some words", None, None, None, None, None, None)], SCHEMA)
    assert [g.lang_pred for g in identify_languages(blank).collect()] == ["und"]
    assert identify_languages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(6)
    for n in (1, 2, 6):
        leads, step, start = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist(), rng.normal(size=2).tolist()
        value = lambda y: start[y[0]] + sum(l * v for l, v in zip(leads, y)) + sum(step[a][b] for a, b in zip(y, y[1:]))
        assert tuple(H.viterbi(leads, step, start)) == max(itertools.product((0, 1), repeat=n), key=value)


def test_leaf_blocks_survive_broken_markup():
    page = "x<p>a &amp; b\n\n c<p>d<b>e<br>f</div></b><script>var t='</p>';</script><!-- no --><ul><li><a href='>'>g</a><li>h<"
    assert [b[0] for b in H.leaf_blocks(page)] == ["x", "a & b c", "de", "f", "g", "h<"] or [b[0] for b in H.leaf_blocks(page)] == ["x", "a & b c", "def", "g", "h<"]
    assert H.leaf_blocks("") == [] and H.leaf_blocks("<" * 2000)[0][0] == "<" * 2000


def test_extraction_on_unseen_layouts(spark):
    model, draw, right, clean = H.trained(), np.random.default_rng(77), 0, lambda p: p.replace("\x01", "").replace("\x02", "")
    pages = [H.labelled_page(draw) for _ in range(120)]
    want = [" ".join(b[0].replace("\x01", "") for b in H.leaf_blocks(p) if "\x01" in b[0]) for p in pages]
    right = sum(H.main_text(clean(p), model) == " ".join(w.split()) for p, w in zip(pages, want))
    assert right >= 105
    from trialworks.llm.html import extract_pages

    rows = [(i, "u", clean(p)) for i, p in enumerate(pages[:20])] + [(None, None, None), (3, "u", ""), (4, "u", "<p>" + "word, " * 50_000 + ".</p>")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(g.n_chars == len(g.text) for g in got)
    assert [g.text for g in got if g.page_id is None] == [""]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
