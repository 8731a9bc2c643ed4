"""A graph over the star-schema test tables, with queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .engine import GraphEngine
from .schema import parse_schema
from .sources import RegisteredSource

SCHEMA = """
schema star_v1 {
  node Region { id: NodeId  @indexed r_regionkey: Int64  @indexed r_name: String }
  node Nation { id: NodeId  @indexed n_nationkey: Int64  @indexed n_name: String }
  node Customer { id: NodeId  @indexed c_custkey: Int64  c_name: String  c_nationkey: Int64  c_acctbal: Float64  @indexed c_mktsegment: String }
  node Supplier { id: NodeId  @indexed s_suppkey: Int64  s_name: String  s_nationkey: Int64  s_acctbal: Float64 }
  node Part { id: NodeId  @indexed p_partkey: Int64  p_name: String  @indexed p_brand: String  p_type: String  p_size: Int64  p_retailprice: Float64 }
  node Orders { id: NodeId  @indexed o_orderkey: Int64  @indexed o_orderstatus: String  o_totalprice: Float64  o_orderdate: Timestamp  o_orderpriority: String }
  node Event { id: NodeId  @indexed event_id: Int64  ts: Timestamp  user_id: Int64  @indexed event_type: String  value: Float64 }
  node Turn { id: NodeId  conv_id: Int64  turn: Int64  @indexed role: String  text: String? }
  node Document { id: NodeId  @indexed doc_id: Int64  text: String?  lang: String  @indexed source: String  n_chars: Int64 }
  node Vec { id: NodeId  @indexed vec_id: Int64  embedding: Vector<Float32, 64>  label: Int64 }
  edge IN_REGION { from: Nation to: Region }
  edge CUST_IN { from: Customer to: Nation }
  edge SUPP_IN { from: Supplier to: Nation }
  edge PLACED { from: Customer to: Orders }
  edge CONTAINS { from: Orders to: Part  l_quantity: Float64  l_extendedprice: Float64  l_discount: Float64  l_tax: Float64  l_returnflag: String  l_shipdate: Timestamp }
  edge SUPPLIED_BY { from: Orders to: Supplier  l_quantity: Float64  l_shipdate: Timestamp }
  edge BOUGHT { from: Customer to: Part  l_quantity: Float64  l_shipdate: Timestamp }
  edge RETURNED { from: Customer to: Part  l_quantity: Float64  l_shipdate: Timestamp }
  edge NEXT_EVENT { from: Event to: Event }
  edge NEXT_TURN { from: Turn to: Turn }
}
"""

#: Ids are ordinal * SPAN + key, so that they are unique across labels and across edge types.
SPAN = 10**12
LABELS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Orders": 6, "Event": 7, "Turn": 8, "Document": 9, "Vec": 10}
TYPES = {"IN_REGION": 1, "CUST_IN": 2, "SUPP_IN": 3, "PLACED": 4, "CONTAINS": 5, "SUPPLIED_BY": 6, "BOUGHT": 7, "RETURNED": 8, "NEXT_EVENT": 9, "NEXT_TURN": 10}
#: Each starts or ends at the row that it is made from, so no two lead from one node to another.
SIMPLE = ("IN_REGION", "CUST_IN", "SUPP_IN", "PLACED", "NEXT_EVENT", "NEXT_TURN")
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _id(ordinal: int, key: Column) -> Column:
    return key.cast("bigint") + F.lit(ordinal * SPAN)


def star_source(spark: SparkSession, sf_dir: str) -> RegisteredSource:
    """The tables under sf_dir as node and edge frames."""
    schema, source = parse_schema(SCHEMA), RegisteredSource()

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(label: str, name: str, key: Callable[[], Column]) -> None:
        props = schema.nodes[label].properties
        source.register_nodes(label, lambda: table(name).select(_id(LABELS[label], key()).alias("node_id"), *(F.col(p.name).cast(p.type.spark()).alias(p.name) for p in props)))

    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Orders", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Vec", "embeddings", "vec_id")):
        nodes(label, name, lambda key=key: F.col(key))
    nodes("Turn", "conversations", lambda: F.col("conv_id") * 100 + F.col("turn"))

    def edges(kind: str, frame: Callable[[], DataFrame], key: Callable[[], Column], near: str, src: Callable[[], Column], far: str, dst: Callable[[], Column]) -> None:
        props = [p.name for p in schema.edges[kind].properties]
        source.register_edges(kind, lambda: frame().select(_id(TYPES[kind], key()).alias("edge_id"), _id(LABELS[near], src()).alias("src_node_id"), _id(LABELS[far], dst()).alias("dst_node_id"), *props))

    def col(name: str) -> Callable[[], Column]:
        return lambda: F.col(name)

    def line_key() -> Column:
        return F.col("l_orderkey") * 1000 + F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS))

    def sold(returned: bool) -> DataFrame:
        lines = table("lineitem").withColumn("line_key", line_key())
        lines = lines.where(F.col("l_returnflag") == "R") if returned else lines
        return lines.join(table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def chain() -> DataFrame:
        e = table("events").select("event_id", "user_id", "ts")
        return e.select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id")).where(F.col("next_id").isNotNull())

    def turns() -> DataFrame:
        t = table("conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("k"))
        return t.join(t.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("before"), F.col("k").alias("k2")), (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("before")))

    edges("IN_REGION", lambda: table("nation"), col("n_nationkey"), "Nation", col("n_nationkey"), "Region", col("n_regionkey"))
    edges("CUST_IN", lambda: table("customer"), col("c_custkey"), "Customer", col("c_custkey"), "Nation", col("c_nationkey"))
    edges("SUPP_IN", lambda: table("supplier"), col("s_suppkey"), "Supplier", col("s_suppkey"), "Nation", col("s_nationkey"))
    edges("PLACED", lambda: table("orders"), col("o_orderkey"), "Customer", col("o_custkey"), "Orders", col("o_orderkey"))
    edges("CONTAINS", lambda: table("lineitem"), line_key, "Orders", col("l_orderkey"), "Part", col("l_partkey"))
    edges("SUPPLIED_BY", lambda: table("lineitem"), line_key, "Orders", col("l_orderkey"), "Supplier", col("l_suppkey"))
    edges("BOUGHT", lambda: sold(False), col("line_key"), "Customer", col("o_custkey"), "Part", col("l_partkey"))
    edges("RETURNED", lambda: sold(True), col("line_key"), "Customer", col("o_custkey"), "Part", col("l_partkey"))
    edges("NEXT_EVENT", chain, col("event_id"), "Event", col("event_id"), "Event", col("next_id"))
    edges("NEXT_TURN", turns, col("k"), "Turn", col("k"), "Turn", col("k2"))
    return source


def star_engine(spark: SparkSession, sf_dir: str, **options) -> GraphEngine:
    """References in these tables are whole, so hops need no existence check; edges made from a key are simple."""
    return GraphEngine(spark, SCHEMA, star_source(spark, sf_dir), **{"drop_dangling": False, "simple_edges": SIMPLE} | options)


@dataclass(frozen=True)
class Case:
    text: str
    sql: str | None
    after: Callable[[DataFrame], DataFrame] | None = None
    options: dict = field(default_factory=dict)


_WALK = """WITH RECURSIVE nx AS (SELECT event_id a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events),
w AS (SELECT event_id s, event_id c, 0 d FROM events WHERE event_type = 'signup' UNION SELECT s, b, d + 1 FROM w JOIN nx ON a = c WHERE d < {high} AND b IS NOT NULL)
SELECT DISTINCT s AS e_event_id, c AS f_event_id FROM w JOIN events f ON f.event_id = c WHERE d BETWEEN {low} AND {high}{more}"""
_BOUGHT = "FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey"
_LINE = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) rn FROM lineitem)"

CASES: dict[str, Case] = {
    "resolve_start": Case('MATCH (c:Customer {c_mktsegment: "BUILDING"}) RETURN c.c_custkey', "SELECT c_custkey AS c_c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "resolve_all": Case("MATCH (n:Nation) RETURN n.n_name", "SELECT n_name AS n_n_name FROM nation"),
    "start_range": Case("MATCH (c:Customer) WHERE c.c_acctbal > 5000.0 AND c.c_acctbal <= 7500.5 RETURN c.c_custkey, c.c_acctbal", "SELECT c_custkey AS c_c_custkey, c_acctbal AS c_c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 7500.5"),
    "start_many_filters": Case('MATCH (p:Part {p_brand: "Brand#12", p_size: 10}) WHERE p.p_retailprice >= 1000.0 RETURN p.p_partkey', "SELECT p_partkey AS p_p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size = 10 AND p_retailprice >= 1000"),
    "one_hop_out": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_custkey, o.o_orderkey", "SELECT o_custkey AS c_c_custkey, o_orderkey AS o_o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey"),
    "one_hop_in": Case('MATCH (o:Orders {o_orderstatus: "F"})<-[:PLACED]-(c:Customer) RETURN o.o_orderkey, c.c_name', "SELECT o_orderkey AS o_o_orderkey, c_name AS c_c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"),
    "two_hop_chain": Case('MATCH (c:Customer {c_mktsegment: "BUILDING"})-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part) WHERE o.o_totalprice > 200000.0 AND p.p_size < 20 RETURN c.c_custkey, o.o_orderkey, p.p_partkey', f"SELECT DISTINCT c_custkey AS c_c_custkey, o_orderkey AS o_o_orderkey, p_partkey AS p_p_partkey {_BOUGHT} JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 AND p_size < 20"),
    "v_pattern": Case("MATCH (p:Part)<-[:CONTAINS]-(o:Orders)-[:SUPPLIED_BY]->(s:Supplier) WHERE o.o_totalprice > 300000.0 RETURN p.p_partkey, s.s_suppkey", "SELECT p AS p_p_partkey, s AS s_s_suppkey FROM (SELECT DISTINCT o_orderkey, a.l_partkey p, b.l_suppkey s FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey WHERE o_totalprice > 300000)"),
    "reverse_start": Case('MATCH (c:Customer)-[:CUST_IN]->(n:Nation)-[:IN_REGION]->(r:Region {r_name: "ASIA"}) RETURN c.c_custkey, n.n_name', "SELECT c_custkey AS c_c_custkey, n_name AS n_n_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"),
    "khop_1_3": Case('MATCH (e:Event {event_type: "signup"})-[:NEXT_EVENT*1..3]->(f:Event) RETURN e.event_id, f.event_id', _WALK.format(low=1, high=3, more="")),
    "khop_2_3": Case('MATCH (e:Event {event_type: "signup"})-[:NEXT_EVENT*2..3]->(f:Event) RETURN e.event_id, f.event_id', _WALK.format(low=2, high=3, more="")),
    "khop_0_2": Case('MATCH (e:Event {event_type: "signup"})-[:NEXT_EVENT*0..2]->(f:Event) RETURN e.event_id, f.event_id', _WALK.format(low=1, high=2, more="")),
    "khop_filtered": Case('MATCH (e:Event {event_type: "signup"})-[:NEXT_EVENT*1..3]->(f:Event) WHERE f.event_type = "purchase" RETURN e.event_id, f.event_id', _WALK.format(low=1, high=3, more=" AND f.event_type = 'purchase'")),
    "khop_empty": Case("MATCH (e:Event)-[:NEXT_EVENT*3..1]->(f:Event) RETURN f.event_id", "SELECT event_id AS f_event_id FROM events WHERE FALSE"),
    "turn_chain": Case('MATCH (t:Turn {role: "user"})-[:NEXT_TURN*1..2]->(u:Turn) RETURN t.conv_id, t.turn, u.turn, u.role', "SELECT DISTINCT t.conv_id AS t_conv_id, t.turn AS t_turn, u.turn AS u_turn, u.role AS u_role FROM conversations t JOIN conversations u ON u.conv_id = t.conv_id AND u.turn > t.turn AND u.turn <= t.turn + 2 JOIN conversations m ON m.conv_id = t.conv_id AND m.turn = t.turn + 1 WHERE t.role = 'user'"),
    "edge_alias_props": Case("MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE o.o_totalprice > 300000.0 RETURN o.o_orderkey, p.p_partkey, l.l_quantity", "SELECT o_orderkey AS o_o_orderkey, l_partkey AS p_p_partkey, l_quantity AS l_l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000"),
    "edge_ids": Case("MATCH (o:Orders)-[l:SUPPLIED_BY]->(s:Supplier) WHERE o.o_totalprice > 300000.0 RETURN l, o, s", f"SELECT 6 * {SPAN} + l_orderkey * 1000 + rn AS l, 6 * {SPAN} + l_orderkey AS o, 4 * {SPAN} + l_suppkey AS s FROM {_LINE} JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000"),
    "parallel_collapse": Case("MATCH (o:Orders)-[:CONTAINS]->(p:Part) RETURN o.o_orderkey, p.p_partkey", "SELECT DISTINCT l_orderkey AS o_o_orderkey, l_partkey AS p_p_partkey FROM lineitem"),
    "bag_projection": Case("MATCH (c:Customer)-[:CUST_IN]->(n:Nation) RETURN n.n_name", "SELECT n_name AS n_n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "alias_compare": Case('MATCH (c:Customer {c_mktsegment: "BUILDING"})-[:CUST_IN]->(n:Nation)<-[:CUST_IN]-(d:Customer {c_mktsegment: "MACHINERY"}) WHERE c < d AND c.c_acctbal > 8000.0 RETURN c.c_custkey, d.c_custkey', "SELECT c.c_custkey AS c_c_custkey, d.c_custkey AS d_c_custkey FROM customer c JOIN customer d ON c.c_nationkey = d.c_nationkey WHERE c.c_custkey < d.c_custkey AND c.c_mktsegment = 'BUILDING' AND d.c_mktsegment = 'MACHINERY' AND c.c_acctbal > 8000"),
    "prop_compare": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:SUPPLIED_BY]->(s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal RETURN c.c_custkey, o.o_orderkey, s.s_suppkey", f"SELECT DISTINCT c_custkey AS c_c_custkey, o_orderkey AS o_o_orderkey, s_suppkey AS s_s_suppkey {_BOUGHT} JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey AND c_acctbal < s_acctbal"),
    "edge_filter": Case("MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE l.l_discount >= 0.05 AND l.l_quantity < 5.0 RETURN o.o_orderkey, p.p_partkey, l.l_discount", "SELECT l_orderkey AS o_o_orderkey, l_partkey AS p_p_partkey, l_discount AS l_l_discount FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 5"),
    "ts_filter": Case('MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_orderdate >= "1997-01-01T02:00:00+02:00" AND o.o_orderdate < "1997-03-01T00:00:00Z" RETURN c.c_custkey, o.o_orderdate', "SELECT o_custkey AS c_c_custkey, o_orderdate AS o_o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01'"),
    "cycle_join": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part)<-[:RETURNED]-(c:Customer) RETURN c.c_custkey, o.o_orderkey, p.p_partkey", f"SELECT DISTINCT c_custkey AS c_c_custkey, o_orderkey AS o_o_orderkey, l_partkey AS p_p_partkey {_BOUGHT} WHERE EXISTS (SELECT 1 FROM orders o2 JOIN lineitem l2 ON l2.l_orderkey = o2.o_orderkey WHERE o2.o_custkey = c.c_custkey AND l2.l_partkey = l.l_partkey AND l2.l_returnflag = 'R')"),
    "anti_basic": Case('MATCH (c:Customer {c_mktsegment: "BUILDING"})-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part) WHERE o.o_totalprice > 200000.0 AND NOT EXISTS { MATCH (c)-[:RETURNED]->(p) } RETURN c.c_custkey, o.o_orderkey, p.p_partkey', f"SELECT DISTINCT c_custkey AS c_c_custkey, o_orderkey AS o_o_orderkey, l_partkey AS p_p_partkey {_BOUGHT} WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 AND NOT EXISTS (SELECT 1 FROM orders o2 JOIN lineitem l2 ON l2.l_orderkey = o2.o_orderkey WHERE o2.o_custkey = c.c_custkey AND l2.l_partkey = l.l_partkey AND l2.l_returnflag = 'R')"),
    "anti_correlated": Case("MATCH (c:Customer)-[b:BOUGHT]->(p:Part) WHERE b.l_quantity > 45.0 AND NOT EXISTS { MATCH (c)-[r:RETURNED]->(p) WHERE r.l_quantity >= b.l_quantity AND b.l_shipdate <= r.l_shipdate } RETURN c.c_custkey, p.p_partkey, b.l_quantity", f"SELECT c_custkey AS c_c_custkey, l_partkey AS p_p_partkey, l_quantity AS b_l_quantity {_BOUGHT} WHERE l_quantity > 45 AND NOT EXISTS (SELECT 1 FROM orders o2 JOIN lineitem r ON r.l_orderkey = o2.o_orderkey WHERE o2.o_custkey = c.c_custkey AND r.l_partkey = l.l_partkey AND r.l_returnflag = 'R' AND r.l_quantity >= l.l_quantity AND r.l_shipdate >= l.l_shipdate)"),
    "anti_two": Case('MATCH (c:Customer)-[b:BOUGHT]->(p:Part) WHERE b.l_quantity > 40.0 AND NOT EXISTS { MATCH (c)-[r:RETURNED]->(p) WHERE r.l_quantity > 30.0 } AND NOT EXISTS { MATCH (c)-[x:BOUGHT]->(p) WHERE x.l_quantity > 45.0 AND c.c_mktsegment = "BUILDING" } RETURN c.c_custkey, p.p_partkey, b', f"SELECT c_custkey AS c_c_custkey, l_partkey AS p_p_partkey, 7 * {SPAN} + l_orderkey * 1000 + rn AS b FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN {_LINE} l ON l.l_orderkey = o.o_orderkey WHERE l_quantity > 40 AND NOT EXISTS (SELECT 1 FROM orders o2 JOIN lineitem r ON r.l_orderkey = o2.o_orderkey WHERE o2.o_custkey = c.c_custkey AND r.l_partkey = l.l_partkey AND r.l_returnflag = 'R' AND r.l_quantity > 30) AND NOT EXISTS (SELECT 1 FROM orders o2 JOIN lineitem r ON r.l_orderkey = o2.o_orderkey WHERE o2.o_custkey = c.c_custkey AND r.l_partkey = l.l_partkey AND r.l_quantity > 45 AND c.c_mktsegment = 'BUILDING')"),
    "untyped_edge": Case("MATCH (n:Nation)-->(x) RETURN n.n_name, x", f"SELECT n_name AS n_n_name, {SPAN} + n_regionkey AS x FROM nation"),
    "untyped_in": Case('MATCH (n:Nation {n_name: "FRANCE"})<--(x) RETURN n.n_name, x', f"SELECT n_name AS n_n_name, x FROM nation JOIN (SELECT c_nationkey k, 3 * {SPAN} + c_custkey x FROM customer UNION ALL SELECT s_nationkey, 4 * {SPAN} + s_suppkey FROM supplier) ON k = n_nationkey WHERE n_name = 'FRANCE'"),
    "unlabeled_start": Case('MATCH (x)-[:IN_REGION]->(r:Region {r_name: "EUROPE"}) RETURN x', f"SELECT 2 * {SPAN} + n_nationkey AS x FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'"),
    "order_limit_desc": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN o.o_orderkey, c.c_name ORDER BY o.o_orderkey DESC LIMIT 25", "SELECT o_orderkey AS o_o_orderkey, c_name AS c_c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderkey DESC LIMIT 25"),
    "order_limit_asc": Case("MATCH (p:Part) RETURN p.p_partkey, p.p_name ORDER BY p.p_partkey ASC LIMIT 40", "SELECT p_partkey AS p_p_partkey, p_name AS p_p_name FROM part ORDER BY p_partkey LIMIT 40"),
    "order_by_unprojected": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_custkey ORDER BY o.o_orderkey LIMIT 30", "SELECT o_custkey AS c_c_custkey FROM orders ORDER BY o_orderkey LIMIT 30"),
    "type_mismatch_empty": Case('MATCH (c:Customer) WHERE c.c_custkey = "1" RETURN c.c_name', "SELECT c_name AS c_c_name FROM customer WHERE FALSE"),
    "dangling_check": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE c.c_acctbal < 0.0 RETURN c, o", f"SELECT 3 * {SPAN} + o_custkey AS c, 6 * {SPAN} + o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0", options={"drop_dangling": True}),
    "compat_hop": Case('MATCH (c:Customer {c_mktsegment: "BUILDING", c_custkey: 1})-[:PLACED]->(o:Orders) WHERE o.o_orderstatus <> "F" AND c <> c RETURN c.c_custkey, o.o_orderkey', "SELECT c_custkey AS c_c_custkey, o_orderkey AS o_o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'F'", options={"mode": "compat"}),
    "hydrate_record": Case('MATCH (r:Region {r_name: "ASIA"})<-[:IN_REGION]-(n:Nation) RETURN n, r', f"SELECT 2 * {SPAN} + n_nationkey AS n, {SPAN} + n_regionkey AS r, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'", after=lambda df: df.selectExpr("n", "r", "n_record.n_name AS n_name", "r_record.r_name AS r_name"), options={"hydrate": True}),
    "hydrate_edge": Case("MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE o.o_totalprice > 300000.0 RETURN l, p", f"SELECT 5 * {SPAN} + l_orderkey * 1000 + rn AS l, 5 * {SPAN} + l_partkey AS p, 'CONTAINS' AS edge_type, l_quantity, l_tax, l_shipdate, p_name FROM {_LINE} JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 300000", after=lambda df: df.selectExpr("l", "p", "l_record.edge_type", "l_record.l_quantity", "l_record.l_tax", "l_record.l_shipdate", "p_record.p_name"), options={"hydrate": True}),
    "vector_values": Case("MATCH (v:Vec) WHERE v.label >= 3 RETURN v.vec_id, v.label, v.embedding", "SELECT vec_id AS v_vec_id, label AS v_label, len(embedding) AS dim, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings WHERE label >= 3", after=lambda df: df.selectExpr("v_vec_id", "v_label", "cast(size(v_embedding) as long) AS dim", "cast(v_embedding[0] as double) AS first", "cast(v_embedding[63] as double) AS last")),
    "middle_start": Case('MATCH (c:Customer)-[:PLACED]->(o:Orders {o_orderstatus: "P"})-[s:SUPPLIED_BY]->(x:Supplier)-[:SUPP_IN]->(n:Nation) WHERE s.l_quantity > 40.0 AND c.c_nationkey <> x.s_nationkey RETURN c.c_custkey, s, n.n_name', f"SELECT c_custkey AS c_c_custkey, 6 * {SPAN} + l_orderkey * 1000 + rn AS s, n_name AS n_n_name FROM {_LINE} JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE o_orderstatus = 'P' AND l_quantity > 40 AND c_nationkey <> s_nationkey"),
    "downstream_agg": Case("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_mktsegment, o.o_orderstatus", "SELECT c_mktsegment AS c_c_mktsegment, o_orderstatus AS o_o_orderstatus, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL", after=lambda df: df.groupBy("c_c_mktsegment", "o_o_orderstatus").count().withColumnRenamed("count", "n_orders")),
}


def _run(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = dict(case.options)
        hydrate = options.pop("hydrate", False)
        df = star_engine(spark, sf_dir, **options).execute(case.text, hydrate)
        return case.after(df) if case.after else df

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(case) for name, case in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql for name, case in CASES.items() if case.sql is not None}
