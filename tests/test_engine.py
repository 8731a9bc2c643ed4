"""Language, schema text and small graphs with known answers: a railway, and a library's loans."""

import datetime
import json
import os
import subprocess
import sys
import time

import pytest

from weftgraph import CsvSource, GraphEngine, ParquetSource, RegisteredSource, TableSource, parse_schema
from weftgraph.dsl import SyntaxFault, ValidationFailed, parse
from weftgraph.dsl.validate import violations
from weftgraph.operators.compile import HopLimit
from weftgraph.plans.lower import UnsupportedShape
from weftgraph.schema import SchemaError, diff
from weftgraph.sources import MissingTable, NonConforming, append_table, commit_table, to_json_rows, to_node_link
from weftgraph.streaming import RefreshLoop

RAIL = "schema rail_2 { node Stop { id: NodeId @indexed code: String @indexed opened: Int64 } edge TRACK { from: Stop to: Stop km: Int64? } }"
STOPS = [(11, "Aue", 1866), (12, "Brand", 1901), (13, "Calw", 1872), (14, "Dorf", 1930), (15, "Elm", None), (16, "Forst", 1888)]
TRACKS = [(900, 11, 12, 14), (901, 12, 13, 3), (902, 13, 14, None), (903, 14, 15, 8), (904, 15, 16, 21)]
NODE, EDGE = "node_id long, code string, opened long", "edge_id long, src_node_id long, dst_node_id long, km long"


def rail(spark, tracks=TRACKS, stops=STOPS, **options):
    source = RegisteredSource().register_nodes("Stop", spark.createDataFrame(stops, NODE)).register_edges("TRACK", spark.createDataFrame(tracks, EDGE))
    return GraphEngine(spark, RAIL, source, **options)


def rows(df):
    return [r[0] if len(r) == 1 else tuple(r) for r in df.collect()]


@pytest.mark.parametrize("hops, where, want", [("*1..4", "WHERE t.opened < 1900 ", {13}), ("*2..4", "", {13, 14, 15}), ("*0..2", "", {12, 13}), ("*5..5", "", {16}), ("*4..2", "", set())])
def test_walks(spark, hops, where, want):
    assert set(rows(rail(spark).execute(f'MATCH (s:Stop {{code: "Aue"}})-[:TRACK{hops}]->(t:Stop) {where}RETURN t'))) == want


def test_long_walks_round_a_circle(spark):
    circle = [(i, i, i % 10 + 1, 1) for i in range(1, 11)]
    e = rail(spark, circle, [(i, f"s{i}", i) for i in range(1, 11)])
    assert set(rows(e.execute('MATCH (s:Stop {code: "s1"})-[:TRACK*11..14]->(t:Stop) RETURN t'))) == {2, 3, 4, 5}
    assert len(rows(e.execute('MATCH (s:Stop {code: "s1"})<-[:TRACK*1..32]-(t:Stop) RETURN t'))) == 10
    with pytest.raises(HopLimit):
        e.execute("MATCH (s:Stop)-[:TRACK*1..33]->(t:Stop) RETURN t")


def test_order_limit_and_null_keys(spark):
    e = rail(spark)
    assert rows(e.execute('MATCH (s:Stop {code: "Aue"})-[:TRACK*1..3]->(t:Stop) RETURN t.code ORDER BY t.opened DESC LIMIT 2')) == ["Dorf", "Brand"]
    assert rows(e.execute("MATCH (s:Stop) RETURN s.code ORDER BY s.opened DESC LIMIT 1")) == ["Elm"]
    assert rows(e.execute("MATCH (s:Stop) RETURN s.code ORDER BY s.opened"))[-1] == "Elm"
    assert set(rows(e.execute('MATCH (s:Stop {code: "Elm"})<-[:TRACK*1..2]-(t:Stop) RETURN t.code'))) == {"Dorf", "Calw"}


def test_parallel_tracks(spark):
    e = rail(spark, [(1, 11, 12, 5), (2, 11, 12, 9), (3, 12, 11, 5), (4, 12, 77, 4), (5, 12, 13, 1), (6, 12, 13, 2)])
    assert set(rows(e.execute('MATCH (a:Stop {code: "Aue"})-[:TRACK*1..3]->(b:Stop) RETURN b'))) == {11, 12, 13}
    assert len(rows(e.execute("MATCH (a:Stop)-[:TRACK]->(b:Stop) RETURN a, b"))) == 3
    assert sorted(rows(e.execute("MATCH (a:Stop)-[k:TRACK]->(b:Stop) RETURN k"))) == [1, 2, 3, 5, 6]
    assert sorted(rows(e.execute("MATCH (a:Stop)-[:TRACK]->(b:Stop)-[:TRACK]->(c:Stop) RETURN a, b, c"))) == [(11, 12, 11), (11, 12, 13), (12, 11, 12)]
    assert len(rows(e.execute("MATCH (a:Stop)-[:TRACK]->(b:Stop)-[k:TRACK]->(c:Stop) RETURN a, k"))) == 5
    assert rows(e.execute("MATCH (a:Stop)-[:TRACK]->(b:Stop)-[:TRACK]->(a:Stop) WHERE a < b RETURN a")) == [11]


def test_simple_edges_need_no_collapse(spark):
    e = rail(spark, simple_edges=["TRACK"])
    text = "MATCH (a:Stop)-[:TRACK]->(b:Stop)-[:TRACK]->(c:Stop) RETURN a, c"
    assert sorted(rows(e.execute(text))) == sorted(rows(rail(spark).execute(text))) == [(11, 13), (12, 14), (13, 15), (14, 16)]
    assert "Aggregate" not in e.execute(text)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        rail(spark, simple_edges=["ROAD"])


def test_any_start_gives_the_same_rows(spark):
    text = 'MATCH (a:Stop)-[:TRACK]->(b:Stop)-[k:TRACK]->(c:Stop {code: "Dorf"})<-[:TRACK*1..2]-(d:Stop) WHERE b.opened < 1900 RETURN a, k, c, d'
    fast, plain = rail(spark), rail(spark, reorder=False)
    assert fast.plan(text).start.alias == "c" and plain.plan(text).start.alias == "a"
    assert sorted(rows(fast.execute(text))) == sorted(rows(plain.execute(text))) == [(12, 902, 14, 12), (12, 902, 14, 13)]
    assert rail(spark).plan("MATCH (a:Stop)-[:TRACK]->(b:Stop)-[:TRACK]->(c:Stop) WHERE b.opened > 1 RETURN a").start.alias == "b"


def test_records(spark):
    e = rail(spark)
    r = e.execute('MATCH (a:Stop {code: "Brand"})-[k:TRACK]->(b:Stop) WHERE k.km <= 3 RETURN a, k, b', hydrate=True).first()
    assert (r.a_record.label, r.a_record.opened, r.k, r.k_record.edge_type, r.k_record.km, r.b_record.code) == ("Stop", 1901, 901, "TRACK", 3, "Calw")
    assert json.loads(next(to_json_rows(e.execute('MATCH (s:Stop {code: "Elm"}) RETURN s', hydrate=True)))) == {"s": 15, "s_record": {"label": "Stop", "code": "Elm"}}


def test_anti_join_and_modes(spark):
    text = "MATCH (a:Stop)-[:TRACK]->(b:Stop) WHERE NOT EXISTS { MATCH (a)-[k:TRACK]->(b) WHERE k.km >= 8 } RETURN a"
    assert sorted(rows(rail(spark).execute(text))) == [12, 13]
    outer = "MATCH (a:Stop)-[e:TRACK]->(b:Stop) WHERE NOT EXISTS { MATCH (a)-[k:TRACK]->(b) WHERE k.km > e.km } RETURN a"
    assert sorted(rows(rail(spark).execute(outer))) == [11, 12, 14, 15]  # a null outer value drops the binding
    compat = rail(spark, mode="compat")
    assert sorted(rows(compat.execute("MATCH (a:Stop)-[:TRACK]->(b:Stop) WHERE a = b RETURN a"))) == [11, 12, 13, 14, 15]
    with pytest.raises(UnsupportedShape):
        compat.execute("MATCH (a:Stop) WHERE a.opened > 1 RETURN a")


def test_readers_who_never_borrow(spark):
    """Who may take a branch's rare books, but hasn't taken one in the allowed way for years?"""
    schema = "schema library_5 { node Reader { id: NodeId card: String } node Branch { id: NodeId town: String } node Book { id: NodeId title: String rare: Bool } edge JOINED { from: Reader to: Branch } edge LENDS { from: Branch to: Book how: String } edge TOOK { from: Reader to: Book how: String back: Timestamp } }"
    s = RegisteredSource()
    s.register_nodes("Reader", spark.createDataFrame([(1, "R-1"), (2, "R-2"), (3, "R-3"), (4, "R-4"), (5, "R-5")], "node_id long, card string"))
    s.register_nodes("Branch", spark.createDataFrame([(50, "Ulm"), (51, "Hof")], "node_id long, town string"))
    s.register_nodes("Book", spark.createDataFrame([(80, "Atlas", True), (81, "Diary", False)], "node_id long, title string, rare boolean"))
    plain = "edge_id long, src_node_id long, dst_node_id long"
    s.register_edges("JOINED", spark.createDataFrame([(1000 + r, r, 51 if r == 5 else 50) for r in range(1, 6)], plain))
    s.register_edges("LENDS", spark.createDataFrame([(2000, 50, 80, "reading room"), (2001, 50, 81, "home"), (2002, 51, 81, "home")], plain + ", how string"))
    took = [(3000, 1, 80, "reading room", "2019-06-30T23:59:59"), (3001, 2, 80, "reading room", "2020-02-29T12:00:00"), (3002, 3, 80, "home", "2023-01-05T09:00:00"), (3003, 4, 81, "home", "2023-01-05T09:00:00")]
    s.register_edges("TOOK", spark.createDataFrame(took, plain + ", how string, b string").selectExpr("edge_id", "src_node_id", "dst_node_id", "how", "cast(b as timestamp_ntz) back"))
    text = 'MATCH (r:Reader)-[:JOINED]->(h:Branch)-[l:LENDS]->(b:Book) WHERE b.rare = true AND NOT EXISTS { MATCH (r)-[t:TOOK]->(b) WHERE t.how = l.how AND t.back >= "2020-01-01T01:00:00+01:00" } RETURN r.card, b.title'
    assert sorted(rows(GraphEngine(spark, schema, s).execute(text))) == [("R-1", "Atlas"), ("R-3", "Atlas"), ("R-4", "Atlas")]


def test_every_type_of_value(spark):
    schema = "schema kinds { node Thing { id: NodeId ok: Bool raw: Bytes? at: Timestamp tags: List<String> place: Vector<Float32, 3> x: Float64 } }"
    made = [(1, True, b"\x00\xff", datetime.datetime(2021, 5, 4, 3, 2, 1), ["a", "b"], [1.0, 2.0, 0.5], 0.25), (2, False, None, datetime.datetime(1999, 1, 1), [], [0.0, 0.0, 0.0], -1.5), (3, None, b"", None, None, None, None)]
    e = GraphEngine(spark, schema, RegisteredSource().register_nodes("Thing", spark.createDataFrame(made, "node_id long, ok boolean, raw binary, at timestamp_ntz, tags array<string>, place array<float>, x double")))
    assert sorted(rows(e.execute("MATCH (t:Thing) WHERE t.ok = true RETURN t, t.raw, t.at, t.tags, t.place, t.x"))) == [(1, bytearray(b"\x00\xff"), made[0][3], ["a", "b"], [1.0, 2.0, 0.5], 0.25)]
    assert rows(e.execute("MATCH (t:Thing) WHERE t.ok <> true RETURN t.tags")) == [[]]
    assert rows(e.execute("MATCH (t:Thing {ok: false}) RETURN t.x")) == [-1.5]
    record = e.execute("MATCH (t:Thing {ok: true}) RETURN t", hydrate=True).first().t_record
    assert (record.ok, bytes(record.raw), record.place, record.tags) == (True, b"\x00\xff", [1.0, 2.0, 0.5], ["a", "b"])
    for bad in ('t.tags = "a"', "t.place > 1", "t.ok < true"):
        with pytest.raises(ValidationFailed):
            e.execute(f"MATCH (t:Thing) WHERE {bad} RETURN t")


@pytest.mark.parametrize("text", ["MATCH (s:Stop)", "SEEK (s) RETURN s", "MATCH (s) WHERE s.km = 1 AND RETURN s", "MATCH (s)-[:TRACK*]->(t) RETURN s", "MATCH (s)-[:TRACK*2..]->(t) RETURN s", "MATCH (s) WHERE NOT EXISTS { MATCH (s)-->(t) RETURN s", "MATCH (s) WHERE s.km = 123456789012345678901 RETURN s"])
def test_syntax_faults(text):
    with pytest.raises(SyntaxFault):
        parse(text)


@pytest.mark.parametrize("text, kind", [("MATCH (s:Port) RETURN s", "UnknownLabel"), ("MATCH (s:Stop)-[:ROAD]->(t) RETURN s", "UnknownEdgeType"), ("MATCH (s:Stop) RETURN s.height", "UnknownProperty"), ('MATCH (s:Stop) WHERE s.code >= "B" RETURN s', "IncompatibleOperator"), ("MATCH (s:Stop) RETURN u", "UnknownAlias"), ("MATCH (s:Stop)-[k:TRACK*2..3]->(t) RETURN s", "EdgeAliasOnVariableLengthHop"), ("MATCH (s:Stop) WHERE NOT EXISTS { MATCH (s)-->(u) } RETURN s", "NotExistsAnchorNotPreBound"), ("MATCH (s:Stop) WHERE NOT EXISTS { MATCH (s) } RETURN s", "NotExistsWrongShape"), ("MATCH (s:Stop)-->(t) WHERE NOT EXISTS { MATCH (s)<--(t) } RETURN s", "NotExistsMustBeOutgoing"), ("MATCH (s:Stop)-->(t) WHERE NOT EXISTS { MATCH (s)-->(t) WHERE NOT EXISTS { MATCH (s)-->(t) } } RETURN s", "NestedNotExists")])
def test_violations(text, kind):
    found = violations(parse(text), parse_schema(RAIL))
    assert [v.kind for v in found] == [kind] and all(str(v) for v in found)


def test_schema_text_and_evolution():
    for bad in ("schema v { node Stop { id: NodeId code } }", "schema v { node Stop { id: NodeId } node Stop { id: NodeId } }", "schema v { edge TRACK { from: Stop to: Port } }"):
        with pytest.raises(SchemaError):
            parse_schema(bad)
    old = parse_schema(RAIL)
    assert diff(old, parse_schema(RAIL.replace("km: Int64?", "km: Int64? built: Timestamp?"))).compatible
    assert not diff(old, parse_schema(RAIL.replace("km: Int64?", "km: Float64?"))).compatible
    assert not diff(old, parse_schema(RAIL.replace("km: Int64?", ""))).compatible


def test_validation_reaches_the_caller(spark):
    with pytest.raises(ValidationFailed, match="Port"):
        rail(spark).execute("MATCH (s:Port) RETURN s")


# -- tables, snapshots, service -------------------------------------------------------------------


def tables(spark):
    return spark.createDataFrame(STOPS, NODE), spark.createDataFrame(TRACKS, EDGE)


def test_snapshots_are_pinned(spark, tmp_path):
    schema, root, (stops, tracks) = parse_schema(RAIL), str(tmp_path), tables(spark)
    append_table(stops, schema, "nodes", "Stop", root)
    append_table(tracks, schema, "edges", "TRACK", root)
    e = GraphEngine(spark, schema, ParquetSource(root))
    append_table(spark.createDataFrame([(17, "Greiz", 1875)], NODE), schema, "nodes", "Stop", root)
    text = "MATCH (s:Stop) RETURN s"
    assert e.execute(text).count() == 6
    e.refresh()
    assert e.execute(text).count() == 7 and e.at(0).execute(text).count() == 6
    assert e.status(counts=True)["edge_count"] == 5 and e.health() and not e.snapshot.check_ids()
    nodes, links = to_node_link(e.snapshot)
    assert {(r.id, r.label, json.loads(r.properties).get("code")) for r in nodes.collect()} == {(i, "Stop", c) for i, c, _ in [*STOPS, (17, "Greiz", 1875)]}
    assert {(r.id, r.source, r.target, r.edge_type, json.loads(r.properties).get("km")) for r in links.collect()} == {(i, a, b, "TRACK", k) for i, a, b, k in TRACKS}


def test_commits(spark, tmp_path):
    schema, root, (stops, tracks) = parse_schema(RAIL), str(tmp_path), tables(spark)
    assert [commit_table(stops, schema, "nodes", "Stop", root), commit_table(tracks, schema, "edges", "TRACK", root)] == [0, 0]
    e, text = GraphEngine(spark, schema, ParquetSource(root)), "MATCH (s:Stop) RETURN s"
    assert e.status()["snapshots"] == {"nodes_stop": "commit-0", "edges_track": "commit-0"}
    stops.write.parquet(f"{root}/nodes_stop/data/half-written")  # a writer that died before its commit
    open(f"{root}/nodes_stop/_commits/1.json", "w").close()  # another is about to commit
    e.refresh()
    assert e.execute(text).count() == 6
    assert commit_table(spark.createDataFrame([(17, "Greiz", 1875)], NODE), schema, "nodes", "Stop", root) == 2
    assert commit_table(spark.createDataFrame([(1, "Ahorn", 1)], NODE), schema, "nodes", "Stop", root, replace=True) == 3
    assert e.execute(text).count() == 6
    e.refresh()
    assert rows(e.execute(text)) == [1] and e.at(1).execute(text).count() == 6
    with pytest.raises(NonConforming):
        commit_table(stops.drop("opened"), schema, "nodes", "Stop", root)


@pytest.mark.parametrize("how", ["parquet", "partitioned", "csv", "orc", "json", "view"])
def test_catalog_tables(spark, how):
    schema, (stops, tracks), db = parse_schema(RAIL), tables(spark), f"rail_{how}"
    with pytest.raises(MissingTable):
        GraphEngine(spark, schema, TableSource(db, create=True))
    text = "MATCH (s:Stop)-[k:TRACK]->(t:Stop) WHERE k.km > 3 RETURN s.code, k.km, t.opened"
    want = [("Aue", 14, 1901), ("Dorf", 8, None), ("Elm", 21, 1888)]
    for name, df in (("nodes_stop", stops), ("edges_track", tracks)):
        if how == "view":
            df.createOrReplaceTempView(f"v_{name}")
            spark.sql(f"CREATE TABLE {db}.base_{name} USING parquet AS SELECT * FROM v_{name}")
            spark.sql(f"CREATE VIEW {db}.{name} AS SELECT * FROM {db}.base_{name}")
        elif how == "partitioned":
            df.write.partitionBy("opened" if name == "nodes_stop" else "km").saveAsTable(f"{db}.{name}")
        else:
            df.write.format(how).options(**({"header": "true", "sep": ";"} if how == "csv" else {})).saveAsTable(f"{db}.{name}")
    e = GraphEngine(spark, schema, TableSource(db))
    assert sorted(rows(e.execute(text)), key=repr) == want
    if how != "view":
        spark.createDataFrame([(905, 16, 11, 40)], EDGE).write.insertInto(f"{db}.edges_track")
        assert sorted(rows(e.execute(text)), key=repr) == want
        e.refresh()
        assert len(rows(e.execute(text))) == 4 and sorted(rows(e.at(0).execute(text)), key=repr) == want
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_partitioned_folders_and_csv(spark, tmp_path):
    schema, (stops, tracks) = parse_schema(RAIL), tables(spark)
    stops.write.partitionBy("opened").parquet(f"{tmp_path}/p/nodes_stop")
    tracks.write.partitionBy("km").parquet(f"{tmp_path}/p/edges_track")
    stops.write.option("header", "true").csv(f"{tmp_path}/c/nodes_stop")
    tracks.write.option("header", "true").csv(f"{tmp_path}/c/edges_track")
    text = 'MATCH (s:Stop {code: "Aue"})-[k:TRACK]->(t:Stop) RETURN s.opened, k.km, t.code'
    for source in (ParquetSource(f"{tmp_path}/p"), CsvSource(f"{tmp_path}/c", schema)):
        assert rows(GraphEngine(spark, schema, source).execute(text)) == [(1866, 14, "Brand")]
    with pytest.raises(MissingTable):
        GraphEngine(spark, schema, ParquetSource(f"{tmp_path}/none"))


def test_refresh_loop(spark, tmp_path):
    schema, root, (stops, tracks) = parse_schema(RAIL), str(tmp_path), tables(spark)
    commit_table(stops, schema, "nodes", "Stop", root)
    commit_table(tracks, schema, "edges", "TRACK", root)
    e = GraphEngine(spark, schema, ParquetSource(root))
    loop = RefreshLoop(e, 0.2).start()
    commit_table(spark.createDataFrame([(17, "Greiz", 1875)], NODE), schema, "nodes", "Stop", root)
    end = time.time() + 30
    while e.execute("MATCH (s:Stop) RETURN s").count() < 7 and time.time() < end:
        time.sleep(0.1)
    loop.stop()
    assert e.execute("MATCH (s:Stop) RETURN s").count() == 7 and loop.failures == 0
    os.rename(f"{root}/edges_track", f"{root}/gone")
    assert not loop.once() and loop.failures == 1 and e.execute("MATCH (s:Stop) RETURN s").count() == 7


def test_metrics(spark):
    e = rail(spark)
    assert len(e.collect("MATCH (s:Stop)-[:TRACK]->(t:Stop) RETURN s")) == 5
    with pytest.raises(SyntaxFault):
        e.execute("MATCH")
    text = e.metrics_text()
    for line in ("# TYPE graph_query_latency_seconds summary", "graph_query_latency_seconds_count 1", "graph_hop_latency_seconds_count 1", "graph_queries_total 2", "graph_query_errors_total 1", "graph_rebuilds_total 1", "# TYPE graph_snapshot_age_seconds gauge"):
        assert line in text.splitlines()


def test_command_line(spark, tmp_path):
    schema, root, (stops, tracks) = parse_schema(RAIL), f"{tmp_path}/t", tables(spark)
    append_table(stops, schema, "nodes", "Stop", root)
    append_table(tracks, schema, "edges", "TRACK", root)
    (tmp_path / "rail.schema").write_text(RAIL)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-m", "weftgraph", f"{tmp_path}/rail.schema", root, 'MATCH (s:Stop {code: "Calw"})-[k:TRACK]->(t:Stop) RETURN k, t.code'], cwd=repo, capture_output=True, text=True, timeout=120)
    assert [json.loads(x) for x in run.stdout.splitlines() if x.startswith("{")] == [{"k": 902, "k_record": {"edge_type": "TRACK"}, "t_code": "Dorf"}]
    assert subprocess.run([sys.executable, "-m", "weftgraph"], cwd=repo, capture_output=True, timeout=60).returncode == 2
