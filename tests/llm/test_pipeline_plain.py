"""The pipeline's first three stages against plain Python, the last two by what they promise, at sf0.01 and on rows with nulls."""

import re
from collections import Counter

import pytest
from compare import SF

import corpus_pipeline
from weftgraph.llm import mixing, quality
from weftgraph.llm.util import stash, table

WORD, BENCH = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def base_ok(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w)


def one_of_each(rows):
    sets = []
    for r in rows:
        w = WORD.findall(fold(r.text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    by, root = {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in by[g] if j < i)
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best[find(i)] = min(best.get(find(i), r.doc_id), r.doc_id)
    return [r for i, r in enumerate(rows) if not sets[i] or best[find(i)] == r.doc_id]


@pytest.fixture(scope="module")
def stages(spark):
    now, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stash(stage(spark, now, SF), "stage")
        out.append((name, now.collect()))
    return out


def test_filtering_stages(spark, stages):
    docs = table(spark, SF, "documents")
    assert not quality.calibrate(quality.text_stats(docs), table(spark, SF, "labels")).values  # too few labels: the base rule alone
    rows = [r for r in docs.collect() if base_ok(r.text)]
    assert sorted(r.doc_id for r in stages[0][1]) == sorted(r.doc_id for r in rows)
    rows = one_of_each(rows)
    assert sorted(r.doc_id for r in stages[1][1]) == sorted(r.doc_id for r in rows)
    windows = set()
    for item in table(spark, SF, "benchmark").collect():
        w = BENCH.findall(fold(item.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def clean(r):
        w = BENCH.findall(fold(r.text))
        return not any(tuple(w[i : i + z]) in windows for z in sizes for i in range(len(w) - z + 1))

    assert sorted(r.doc_id for r in stages[2][1]) == sorted(r.doc_id for r in rows if clean(r))
    texts = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == texts[r.doc_id] for i in range(3) for r in stages[i][1])


def test_mix_and_shards(stages):
    before, mixed, sharded = stages[2][1], stages[3][1], stages[4][1]
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in before}
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(size) and max(times.values()) <= 2
    held, taken = Counter(), Counter()
    for r in before:
        held[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * times[r.doc_id]
    want = mixing.targets(dict(held))
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], 200) for s in held)
    assert Counter(r.doc_id for r in sharded) == times
    by = Counter()
    for r in sharded:
        assert r.size == len((r.text or "").encode()) + 1
        by[r.shard] += r.size
    assert max(by.values()) - min(by.values()) <= 2 * max(r.size for r in sharded)
    for s in by:
        slots = sorted(r.slot for r in sharded if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stages_without_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, SF, "documents")
    for start in (docs.limit(0), docs):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stash(stage(spark, now, str(tmp_path)), "stage")
        assert (now.count() > 0) == (start is docs)
