"""N-grams that most texts hold: out of the fragments, with the same classes."""

import random

import pytest

from weftgraph.llm import ngram_join


@pytest.mark.parametrize(("hot", "least"), [(256, 10_000), (4, 5), (10**6, 3)])
def test_common_passages(spark, monkeypatch, hot, least):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    notice, rows = [f"n{i}" for i in range(40)], []
    for i in range(60):
        own = rnd.sample(words, 30)
        rows += [(3 * i, notice + own), (3 * i + 1, notice + own[:-1]), (3 * i + 2, rnd.sample(words, 50))]
    rows += [(1000 + i, notice) for i in range(5)] + [(2000, notice + notice[:9])]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", least)
    sets = {i: {tuple(x[j : j + 4]) for j in range(len(x) - 3)} for i, x in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, n=4, percent=80).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
