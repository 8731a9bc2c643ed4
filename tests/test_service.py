"""The HTTP bridge on a small ferry network."""

import http.client
import json
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from weftgraph import GraphEngine, RegisteredSource, parse_schema
from weftgraph.service import QueryServer
from weftgraph.sources import append_table

FERRY = "schema ferry_1 { node Pier { id: NodeId @indexed name: String berths: Int64? } node Buoy { id: NodeId colour: String } edge SAILS { from: Pier to: Pier minutes: Int64 } edge MARKS { from: Buoy to: Pier } }"


@pytest.fixture(scope="module")
def server(spark):
    source = RegisteredSource()
    source.register_nodes("Pier", spark.createDataFrame([(1, "Hoy", 2), (2, "Rousay", None), (3, "Stronsay", 1)], "node_id long, name string, berths long"))
    source.register_nodes("Buoy", spark.createDataFrame([(8, "red \"1\"")], "node_id long, colour string"))
    source.register_edges("SAILS", spark.createDataFrame([(50, 1, 2, 35), (51, 2, 3, 80)], "edge_id long, src_node_id long, dst_node_id long, minutes long"))
    source.register_edges("MARKS", spark.createDataFrame([(60, 8, 3)], "edge_id long, src_node_id long, dst_node_id long"))
    with QueryServer(GraphEngine(spark, FERRY, source), port=0) as s:
        yield s


def ask(server, body, path="/api/query", method="POST"):
    c = http.client.HTTPConnection(server.host, server.port, timeout=120)
    c.request(method, path, body if body is None or isinstance(body, str) else json.dumps(body))
    r = c.getresponse()
    text = r.read().decode()
    c.close()
    return r.status, json.loads(text) if r.getheader("Content-Type") == "application/json" else text


def test_rows(server):
    status, got = ask(server, {"dsl": 'MATCH (p:Pier {name: "Hoy"})-[s:SAILS]->(q:Pier) RETURN p, s, q, s.minutes, q.berths'})
    assert status == 200
    assert got == {"rows": [{"p": {"label": "Pier", "properties": {"name": "Hoy", "berths": 2}}, "s": {"edge_type": "SAILS", "properties": {"minutes": 35}}, "q": {"label": "Pier", "properties": {"name": "Rousay", "berths": None}}, "s.minutes": 35, "q.berths": None}]}


def test_node_of_any_label(server):
    status, got = ask(server, {"dsl": 'MATCH (p:Pier {name: "Stronsay"})<--(x) RETURN x'})
    assert status == 200
    key = lambda r: r["x"]["label"]
    assert sorted(got["rows"], key=key) == [{"x": {"label": "Buoy", "properties": {"colour": 'red "1"'}}}, {"x": {"label": "Pier", "properties": {"name": "Rousay"}}}]


def test_no_rows(server):
    assert ask(server, {"dsl": 'MATCH (p:Pier {name: "Unst"}) RETURN p.name'}) == (200, {"rows": []})


@pytest.mark.parametrize("body", [{"dsl": "MATCH (p:Pier"}, {"dsl": "MATCH (p:Quay) RETURN p"}, {"dsl": "MATCH (p:Pier)-[:SAILS*1..99]->(q:Pier) RETURN q"}, {"dsl": 5}, {"query": "x"}, [], "{", ""])
def test_faults_of_the_caller(server, body):
    status, got = ask(server, body)
    assert status == 400 and got["error"]


def test_faults_of_the_engine(server, monkeypatch):
    from weftgraph.engine import GraphEngine as Engine

    for fault, code in ((ConnectionRefusedError("gone"), 502), (RuntimeError("broken\nmore"), 500)):
        def fail(*_, fault=fault):
            raise fault

        monkeypatch.setattr(Engine, "plan", fail)
        status, got = ask(server, {"dsl": "MATCH (p:Pier) RETURN p"})
        assert status == code and "\n" not in got["error"]


def test_other_paths(server):
    assert ask(server, None, "/health", "GET") == (200, {"ok": True})
    status, text = ask(server, None, "/metrics", "GET")
    assert status == 200 and "graph_rebuilds_total 1" in text.splitlines()
    assert ask(server, None, "/else", "GET")[0] == 404 and ask(server, {"dsl": ""}, "/else")[0] == 404


def test_command(spark, tmp_path):
    schema, root = parse_schema(FERRY), f"{tmp_path}/t"
    append_table(spark.createDataFrame([(1, "Hoy", 2)], "node_id long, name string, berths long"), schema, "nodes", "Pier", root)
    append_table(spark.createDataFrame([], "node_id long, colour string"), schema, "nodes", "Buoy", root)
    for name, more in (("SAILS", ", minutes long"), ("MARKS", "")):
        append_table(spark.createDataFrame([], "edge_id long, src_node_id long, dst_node_id long" + more), schema, "edges", name, root)
    (tmp_path / "ferry.schema").write_text(FERRY)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.Popen([sys.executable, "-m", "weftgraph", "serve", f"{tmp_path}/ferry.schema", root, "0"], cwd=repo, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
    try:
        port = int(run.stdout.readline().split(":")[2].split("/")[0])
        assert ask(SimpleNamespace(host="127.0.0.1", port=port), {"dsl": "MATCH (p:Pier) RETURN p.name"}) == (200, {"rows": [{"p.name": "Hoy"}]})
    finally:
        run.kill()
        run.wait()
