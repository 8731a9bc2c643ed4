"""Columns named like anything an operator uses inside, ids that are strings, masks with quotes."""

import inspect
import re

import pytest

from weftgraph.llm import decontaminate, line_dedup, mixing, ngram_join, quality, secrets, sharding


def inner_names(module):
    """Every word in quotes in the operator's source that could be a column's name."""
    return sorted({x for x in re.findall(r'"([a-z][a-z0-9_]*)"', inspect.getsource(module)) if x not in ("doc_id", "text", "source", "lang")})


def frame(spark, names):
    """A table whose further columns have these names and tell their row."""
    rows = [(i, f"One two three, four\nfive six {'seven ' * i}end password = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", "s", "en", *[i] * len(names)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{n}` int" for n in names))


def untouched(out, names):
    rows = out.collect()
    assert rows and all(r[n] == r["doc_id"] for r in rows for n in names)
    return rows


def test_clashing_names(spark):
    added = {"mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_quotas", "shard_size", "shard_crc32", "shard", "slot"}
    names = [n for n in inner_names(mixing) if n not in added]
    assert len(untouched(mixing.mix(frame(spark, names)), names)) == 6
    names = [n for n in inner_names(sharding) if n not in added]
    assert len(untouched(sharding.shard(frame(spark, names), shards=2), names)) == 6
    names = inner_names(decontaminate)
    items = spark.createDataFrame([(1, "four five six seven seven")], "item_id long, text string")
    for options in ({}, {"max_set": 0}):
        assert {r.doc_id for r in untouched(decontaminate.drop_contaminated(frame(spark, names), items, **options), names)} == {0, 1}
        assert len(untouched(decontaminate.remove_spans(frame(spark, names), items, **options), names)) == 6
    names = [n for n in inner_names(ngram_join) if n not in ("row",)] + ["row"]
    assert len(untouched(ngram_join.one_of_each(frame(spark, names), n=2, percent=60), names)) < 6
    names = inner_names(quality)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality.keep(frame(spark, names), labels).columns == frame(spark, names).columns
    names = inner_names(secrets)
    model = secrets.train(secrets.synthetic_findings(spark, 800), trees=4)
    assert len(untouched(secrets.redact(frame(spark, names), model), names)) == 6


def test_names_with_dots_and_capitals(spark):
    docs = spark.createDataFrame([(i, "a b c " * 30, "s", i) for i in range(3)], "doc_id long, text string, source string, `a.B c` int")
    assert untouched(mixing.mix(docs), ["a.B c"]) and untouched(sharding.shard(docs), ["a.B c"])
    assert len(untouched(ngram_join.one_of_each(docs), ["a.B c"])) == 1


def test_string_ids(spark):
    line = "A line of more than twenty characters"
    rows = [("b", "w " * 9 + line), ("a", "w " * 9 + line), (None, "w " * 9 + line), ("c", f"x\n{line}"), ("d", f"y\n{line}"), ("é", f"z\n{line}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs, n=2, percent=80).collect() }
    assert {("a", "a"), ("b", "a"), (None, "a")} <= got
    kept = {r.doc_id: r.kept_text for r in line_dedup.drop_common_lines(docs).collect() if r.doc_id in ("c", "d", "é")}
    assert kept == {"c": "x", "d": "y", "é": f"z\n{line}"}
    for out in (sharding.shard(docs, 2), decontaminate.hits(docs, spark.createDataFrame([("i", "y a line")], "item_id string, text string")), ngram_join.one_of_each(docs, 2, 80)):
        assert out.count() in (5, 7)


@pytest.mark.parametrize("mask", ["it's", 'a "quote"', "$1\\", ""])
def test_masks(spark, mask):
    model = secrets.train(secrets.synthetic_findings(spark, 3000))
    docs = spark.createDataFrame([(1, 'set  password = "83fe01c9d2b74a6e5f9a"\n\t and 83fe01c9d2b74a6e5f9a-checked-by-build.example.com ')], "doc_id long, text string")
    assert secrets.redact(docs, model, mask=mask).first().text == f'set  password = "{mask}"\n\t and 83fe01c9d2b74a6e5f9a-checked-by-build.example.com '
