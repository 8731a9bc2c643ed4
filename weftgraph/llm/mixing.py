"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A pattern's words
flow to the quotas of its sources; a second pass over the same words costs more than the first, a third
more than the second (convex repetition costs), so the flow repeats as little as it can. Documents of a
pattern are then taken in a seeded order up to the routed amounts, whole passes first. The seeded order
is cut in buckets whose sums are known exactly, size class by size class from the largest documents on,
so no document is ranked one by one and one long document can't spoil a source's total.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .util import quoted, stash

#: log2 of the buckets of the seeded order.
BUCKETS_LOG2 = 12
#: Least sizes, in words, of the classes in which documents are selected.
CLASSES = (16, 64, 256, 1024, 4096)
#: Patterns and sources that the flow takes; more is an error, not a silent cut.
MAX_PATTERNS = 100_000
_BAG = "[^ \\t\\n\\x0b\\f\\r]+"


def word_count(text: Column) -> Column:
    """Runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_BAG)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target per source: `share` of all sizes by weight, none above `most` times its source's size.

    Sources weigh `weights`, repeating, by code point with null last. What a full source can't take is
    shared again by weight until none is above its limit.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        rest, by = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / by > most * sizes[s]]
        if not over:
            return {s: full[s] if s in full else rest * weight[s] / by for s in order}
        full |= {s: most * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in full]
    return full


def route(capacity: dict[tuple, int], quota: dict, passes: int = 2) -> dict[tuple, dict]:
    """Words from each pattern to each of its sources: a maximal flow of least repetition cost.

    Pass p of a pattern's words costs p^2, the same for all patterns, and nothing else costs anything. So a
    cheapest augmenting path is one that opens the cheapest pass, and the flow is built pass by pass: each
    pass opens all patterns' capacity once more and is augmented to a maximal flow, which may reroute
    earlier words between sources but never takes them back. Amounts are real numbers.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=repr)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    end = 1 + len(patterns) + len(sources)
    to: list[int] = []
    room: list[float] = []
    graph: list[list[int]] = [[] for _ in range(end + 1)]  # arcs by node; arc k's reverse is k ^ 1

    def arc(u: int, v: int, r: float) -> int:
        graph[u].append(len(to))
        graph[v].append(len(to) + 1)
        to.extend((v, u)), room.extend((r, 0.0))
        return len(to) - 2

    opened = [arc(0, i, 0.0) for i in range(1, len(patterns) + 1)]
    flows = {(p, s): arc(i, place[s], float("inf")) for i, p in enumerate(patterns, 1) for s in p if s in quota}
    for s in sources:
        arc(place[s], end, float(quota[s]))
    tiny = 1e-9 * max(1.0, sum(quota.values()))

    def levels() -> list[int] | None:
        level, queue = [-1] * (end + 1), [0]
        level[0] = 0
        for u in queue:
            for k in graph[u]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[u] + 1
                    queue.append(to[k])
        return level if level[end] >= 0 else None

    for _ in range(passes):
        for k, p in zip(opened, patterns, strict=True):
            room[k] += float(capacity[p])
        while (level := levels()) is not None:  # a blocking flow, arc by arc
            tried, path, u = [0] * (end + 1), [], 0
            while True:
                if u == end:
                    amount = min(room[k] for k in path)
                    for k in path:
                        room[k] -= amount
                        room[k ^ 1] += amount
                    full = next(i for i, k in enumerate(path) if room[k] <= tiny)
                    u = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while tried[u] < len(graph[u]):
                    k = graph[u][tried[u]]
                    if room[k] > tiny and level[to[k]] == level[u] + 1:
                        break
                    tried[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                    continue
                path.append(k)
                u = to[k]
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), k in flows.items():
        out[p][s] = room[k ^ 1]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, text_col: str = "text", members: str | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """All input rows and columns plus mix_size, mix_source_size, mix_target, mix_taken, mix_quotas.

    A document's size is its number of words. Without `members` its sources are its source_col; with it,
    that array column names all sources that hold the document (its size counts for each; mix_source_size
    and mix_target are sums over them). mix_taken is the number of words taken, whole documents times
    whole passes, at most `most` passes: per pattern, all documents up to the last full pass, then
    documents in an order seeded by id and text until the routed words are used up. mix_quotas names, pass
    by pass, the source whose quota the document fills. Null sources are a
    source of their own; a null array of sources holds it alone; null or blank texts have size 0 and are
    taken 0 times; rows with one id and text are taken alike. Input columns named like the added ones are
    replaced, all other names are left alone. Reruns agree. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_quotas")]
    # A null array is one that holds the null source.
    names = F.coalesce(quoted(members).cast("array<string>"), F.array(F.lit(None).cast("string"))) if members else F.array(quoted(source_col).cast("string"))
    # Null can't be a map key or joined by equality, so a pattern is the JSON string of its sorted sources.
    pattern = F.to_json(F.array_sort(F.array_distinct(names)), {"ignoreNullFields": "false"})
    rank = F.xxhash64(F.lit(seed), quoted(id_col), quoted(text_col))
    # Input columns get numbers for names on the way, so none can have a name that is used here.
    rows = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(own)), pattern.alias("pattern"), F.shiftrightunsigned(rank, 64 - BUCKETS_LOG2).cast("int").alias("bucket"), word_count(quoted(text_col).cast("string")).alias("size"))
    rows = rows.withColumn("class", sum((F.col("size") >= x).cast("int") for x in CLASSES))
    sums = stash(rows.groupBy("pattern", "class", "bucket").agg(F.sum("size").alias("words")), "sums")
    per = sums.groupBy("pattern", "class").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(per) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} pairs of a pattern of sources and a size class")
    by_class = {(r["pattern"], r["class"]): int(r["words"]) for r in per}
    capacity: dict[str, int] = {}
    for (k, _), words in by_class.items():
        capacity[k] = capacity.get(k, 0) + words
    sources = {k: tuple(json.loads(k)) for k in capacity}
    sizes: dict[str | None, int] = {}
    for k, p in sources.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + capacity[k]
    goal = targets(sizes, weights, share, float(most))
    flow = route({sources[k]: capacity[k] for k in capacity}, goal, most)
    # Each source takes a stretch of the pattern's words, laid out pass after pass; ends: its (source, pass, words into it).
    ends: dict[str, list[tuple[str | None, int, float]]] = {}
    for k, p in sources.items():
        upto, ends[k] = 0.0, []
        for s in p:
            if capacity[k] and (amount := flow[p].get(s, 0.0)) > 0:
                upto += amount
                full = min(int(upto // capacity[k]), most)
                ends[k].append((s, full, upto - full * capacity[k]))
    cuts = _cuts(sums, by_class, capacity, ends)
    plan = [(k, c, [(s, full, cuts.get((k, c, j), 0)) for j, (s, full, _) in enumerate(ends[k])], sum(sizes[s] for s in sources[k]), float(sum(goal[s] for s in sources[k]))) for k, c in by_class]
    planned = spark.createDataFrame(plan, "plan_pattern string, plan_class int, ends array<struct<source: string, full: int, cut: int>>, source_size long, target double")
    planned = F.broadcast(planned)  # at most MAX_PATTERNS rows
    rows = rows.join(planned, (F.col("pattern") == F.col("plan_pattern")) & (F.col("class") == F.col("plan_class")))
    taker = f"transform(sequence(0, {most - 1}), p -> get(filter(ends, e -> p < e.full or (p = e.full and bucket < e.cut)), 0))"
    rows = rows.withColumn("quotas", F.expr(f"if(size = 0, cast(array() as array<string>), transform(filter({taker}, e -> e is not null), e -> e.source))"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("size") * F.size("quotas")).cast("long").alias("mix_taken"), F.col("quotas").alias("mix_quotas"))


def _cuts(sums: DataFrame, by_class: dict[tuple[str, int], int], capacity: dict[str, int], ends: dict[str, list[tuple]]) -> dict[tuple[str, int, int], int]:
    """(pattern, class, j) -> the bucket before which the documents of its last pass go to source j or one before it.

    Every class gives its share of the pattern's words, at the nearest end of a bucket. What that is off
    by goes to the next smaller class, so the last error is half a bucket of the smallest documents.
    """
    spark, out = sums.sparkSession, {}
    off = {(k, j): 0.0 for k, e in ends.items() for j in range(len(e))}
    upto = F.sum("words").over(W.partitionBy("pattern").orderBy("bucket"))
    for c in range(len(CLASSES), -1, -1):
        share = {(k, j): ends[k][j][2] * w / capacity[k] for (k, d), w in by_class.items() if d == c for j in range(len(ends[k]))}
        want = {(k, j): min(float(by_class[k, c]), max(0.0, x + off[k, j])) for (k, j), x in share.items()}
        if not want:
            continue
        asked = F.broadcast(spark.createDataFrame([(k, j, w) for (k, j), w in want.items()], "k string, j int, want double"))  # a row per pattern and source of it
        steps = sums.where(F.col("class") == c).withColumn("upto", upto).join(asked, F.col("pattern") == F.col("k"))
        best = {(r["k"], r["j"]): r["e"] for r in steps.groupBy("k", "j").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("want")).alias("miss"), "upto", "bucket")).alias("e")).collect()}
        for (k, j), w in want.items():
            if best[k, j]["miss"] <= w:  # else no bucket is nearer than none
                out[k, c, j] = best[k, j]["bucket"] + 1
            off[k, j] += share[k, j] - (best[k, j]["upto"] if (k, c, j) in out else 0)
    return out
