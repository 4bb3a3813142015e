"""Property graphs as nodes(id, label) and edges(src, dst, type): paths, components, degrees, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.session import materialise


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, either end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hub_factor(degree: Column, free: int = 10) -> Column:
    return 1 / (1 + 0.1 * F.greatest(degree - free, F.lit(0)))


def components(pairs: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for undirected `pairs` (a, b).

    Large-star and small-star steps alternate: each node keeps one link to the smallest neighbour, so the edge list never
    grows beyond its start and a hub's links are re-hung instead of multiplied. Rounds grow with the logarithm of the
    longest chain, and each is written to the shared folder, so a lost executor repeats one round at most.
    """
    links = pairs.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    links = materialise(links.filter("u <> v").distinct(), "links")
    before = None
    while True:
        large = _star(links, False)
        links = materialise(_star(large, True), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Hangs a node's larger (large star) or smaller (small star) neighbours on the smallest one it knows."""
    both = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.filter(F.lit(True) if small else F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return (moved.unionByName(own) if small else moved.unionByName(own.filter("u > v"))).filter("u <> v").distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int = 4, per_target: int = 50) -> DataFrame:
    """Shortest-first simple paths of at most `depth` edges from `starts`(id) to `targets`(id), at most `per_target` for
    each start and target: start, target, nodes, length, score = 1 / (length + 0.1 * excess degree of inner nodes).

    Targets end a path. The report's own bound `per_target` is applied at the end; nothing is cut while paths grow.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    excess = degrees(edges.select("src", "dst").distinct()).select("id", F.greatest(F.col("degree") - 10, F.lit(0)).alias("excess"))
    goal = targets.select(F.col("id").alias("dst"), F.lit(True).alias("hit"))
    open_paths = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.col("id").alias("src"), F.lit(0).cast("long").alias("penalty"))
    found = None
    for length in range(1, depth + 1):
        step = open_paths.join(both, "src").filter(~F.array_contains("nodes", F.col("dst"))).join(goal, "dst", "left")
        step = step.select("start", F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("src"), "penalty", F.coalesce("hit", F.lit(False)).alias("hit"))
        done = step.filter("hit").select("start", F.col("src").alias("target"), "nodes", F.lit(length).cast("long").alias("length"), (1 / (F.lit(length) + 0.1 * F.col("penalty"))).alias("score"))
        found = done if found is None else found.unionByName(done)
        open_paths = step.filter("not hit").join(excess.withColumnRenamed("id", "src"), "src").select("start", "nodes", "src", (F.col("penalty") + F.col("excess")).alias("penalty"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("start", "target").orderBy("length", "nodes"))
    return found.withColumn("place", place).filter(F.col("place") <= per_target)


def claim_paths(claims: DataFrame) -> DataFrame:
    """Three-edge chains controller -> role -> access by a three-way join, with the geometric mean of confidence, the number
    of distinct sources, and whether two sources corroborate the chain."""
    def edge(kind: str, i: int) -> DataFrame:
        return claims.filter(F.col("type") == kind).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), F.col("confidence").alias(f"c{i}"), F.col("source").alias(f"s{i}"))

    chain = edge("controls", 0).join(edge("role", 1), "n1").join(edge("access", 2), "n2")
    mean = F.exp((F.ln("c0") + F.ln("c1") + F.ln("c2")) / 3)
    sources = F.size(F.array_distinct(F.array("s0", "s1", "s2")))
    return chain.select("n0", "n1", "n2", "n3", mean.alias("score"), sources.cast("long").alias("sources"), (sources >= 2).alias("corroborated"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges within `rounds` frontiers of the seed nodes, each edge once."""
    known = seeds.select("id").distinct()
    out = None
    for _ in range(rounds):
        touched = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()
        out = touched
        known = touched.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return out


def claim_chains(claims: DataFrame, free: int = 10, sources: int = 2) -> DataFrame:
    """Three-edge chains controller -> role -> access (claims: src, dst, kind, confidence, band, recency, source), by two
    joins: sources, accepted (at least `sources` of them) and score: the geometric mean of confidence * band * recency,
    times diversity min(1, sources / 2), times the hub factor of the two inner nodes; 0 if not accepted."""
    def edge(kind: str, i: int) -> DataFrame:
        weight = F.ln(F.greatest(F.col("confidence") * F.col("band") * F.col("recency"), F.lit(1e-12)))
        return claims.filter(F.col("kind") == kind).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), weight.alias(f"w{i}"), F.col("source").alias(f"s{i}"))

    excess = degrees(claims).select(F.col("id"), F.greatest(F.col("degree") - free, F.lit(0)).alias("excess"))
    inner = lambda i: excess.select(F.col("id").alias(f"n{i}"), F.col("excess").alias(f"x{i}"))
    chain = edge("controller", 0).join(edge("role", 1), "n1").join(edge("access", 2), "n2").join(inner(1), "n1").join(inner(2), "n2")
    n = F.size(F.array_distinct(F.array_compact(F.array("s0", "s1", "s2"))))
    score = F.least(F.lit(1.0), F.exp((F.col("w0") + F.col("w1") + F.col("w2")) / 3) * F.least(F.lit(1.0), n / sources) / (1 + 0.1 * (F.col("x1") + F.col("x2"))))
    return chain.select("n0", "n1", "n2", "n3", n.cast("long").alias("sources"), (n >= sources).alias("accepted"), F.when(n >= sources, score).otherwise(0.0).alias("score"))


def merged_properties(nodes: DataFrame, order: list[str]) -> DataFrame:
    """id, props: of each property of a node (nodes: id, props as a map) the last value by `order` that is not null."""
    each = nodes.select("id", F.explode("props").alias("name", "value"), F.struct(*order).alias("turn")).filter("value is not null")
    last = each.groupBy("id", "name").agg(F.max_by("value", "turn").alias("value"))
    return last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("props"))
