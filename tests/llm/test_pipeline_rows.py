"""The near-duplicate stage on tables with null and repeated ids: one row of each class stays."""

import corpus_pipeline


def test_one_row_of_a_class(spark):
    def prose(k, end=""):
        return " ".join(f"w{k}x{i}" for i in range(60)) + end

    rows = [(1, prose(0), "b"), (1, prose(0), "a"), (1, prose(0, " more"), "a"), (None, prose(1), "a"), (None, prose(1), "a"), (None, prose(1, " more"), "a"), (4, prose(2), "a"), (4, prose(3), "a"), (None, None, "a"), (None, None, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, (r.text or "-").split()[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([(1, "w0x0"), (None, "w1x0"), (4, "w2x0"), (4, "w3x0"), (None, "-"), (None, "-")], key=repr)
