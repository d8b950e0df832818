"""Links of ids divisible by 20 against all rows, by a search without sketches. RECALL_DIR names another folder of tables."""

import os
from collections import Counter, defaultdict

import pytest

from trialworks.llm.minhash import near_duplicates

DIR = os.environ.get("RECALL_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_no_link_of_every_twentieth_row_is_lost(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    sets, where = {}, defaultdict(list)
    for r in docs.select("doc_id", "text").toLocalIterator():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        for s in sets[r.doc_id]:
            where[s].append(r.doc_id)
    got = {r.doc_id: r for r in near_duplicates(docs, k=4, percent=80).collect()}
    links = lost = 0
    for q in (i for i in sets if i % 20 == 0):
        assert got[q].n_shingles == len(sets[q])
        for i, both in Counter(i for s in sets[q] for i in where[s]).items():
            if i != q and 100 * both >= 80 * (len(sets[q]) + len(sets[i]) - both):
                links += 1
                lost += got[i].component_id != got[q].component_id
    print(f"{links} links, {lost} lost")
    assert links and not lost
