"""mix() with overlapping, empty and null arrays of sources."""

from weftgraph.llm import mixing


def test_members(spark):
    arrays = [["a"], ["a", "b"], [], None, [None]]
    rows = [(i, "w " * 20, arrays[i % 5]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    out = mixing.mix(docs, members="held").collect()
    assert len(out) == 500
    size = {i: {r.mix_source_size for r in out if r.doc_id % 5 == i} for i in range(5)}
    assert size == {0: {4000}, 1: {6000}, 2: {0}, 3: {4000}, 4: {4000}}
    assert all(r.mix_taken == 0 for r in out if r.doc_id % 5 == 2)
    assert sum(r.mix_taken for r in out if r.doc_id % 5 in (3, 4)) > 0
