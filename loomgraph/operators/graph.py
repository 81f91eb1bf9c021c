"""Graph kernels over edge tables (src, dst[, weight]). Every one is a plan of joins and aggregations;
traversals stage one table a level, so the plan stays as short at depth 50 as at depth 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..staging import stage


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree of every node with an edge: edges are made once, one shuffle, combined map-side."""
    end = lambda node, i, o: F.struct(F.col(node).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.inline(F.array(end("src", 0, 1), end("dst", 1, 0))))
    return ends.groupBy("id").agg(
        F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"), F.count(F.lit(1)).alias("degree")
    )


def reverse(edges: DataFrame) -> DataFrame:
    """The edges pointing the other way, with their further columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def bfs(edges: DataFrame | tuple[DataFrame, ...], seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of everything reachable along edges, seeds at 0, each at its least depth.

    Several tables of edges are the hops that make an edge together, so a graph of names needs no row a pair.
    A level joins the frontier alone with the edges, drops what has been seen by an anti-join, and is staged;
    it stops at max_depth or at an empty frontier, so cycles end it.
    """
    hops = (edges,) if isinstance(edges, DataFrame) else edges
    frontier = stage(seeds.select(F.col("id")).where("id is not null").distinct().withColumn("depth", F.lit(0)))
    levels, depth = [frontier], 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionAll(level)
        reached = frontier
        for hop in hops:
            reached = hop.join(reached.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = stage(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        levels.append(frontier)
        if len(levels) > 8:  # a long chain: fold what has been seen into one table
            levels = [stage(seen), frontier]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


RISKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def risk(hop: Column) -> Column:
    return F.when(hop == 1, RISKS[0]).when(hop == 2, RISKS[1]).when(hop == 3, RISKS[2]).otherwise(RISKS[3])


def change_impact(calls: DataFrame | tuple[DataFrame, ...], changed: DataFrame, depth: int = 3, min_weight: float | None = None) -> DataFrame:
    """(id, hop, risk) of what calls the changed ids (column id) within `depth` calls, the changed left out; hops as in bfs()."""
    if min_weight is not None:
        calls = calls.where(F.col("weight") >= min_weight)
    hops = (calls.select("src", "dst"),) if isinstance(calls, DataFrame) else calls
    reached = bfs(tuple(reverse(hop) for hop in reversed(hops)), changed, depth)
    return reached.where("depth > 0").select("id", F.col("depth").alias("hop"), risk(F.col("depth")).alias("risk"))


#: A node with over 1/HUB of all edges is a hub, so there are fewer than HUB of them.
HUB = 1000
#: Iterations that are one job, where none needs a number from the one before.
AT_ONCE = 5


def pagerank(edges: DataFrame, nodes: DataFrame, *, damping: float = 0.85, iterations: int = 25) -> DataFrame:
    """(id, score) by fixed iterations from a uniform start; nodes without out-edges share their rank with all.

    Links and nodes are dealt once, by the same key, and kept; then only gains are shuffled, once an iteration. Links of hubs stay
    where they are and meet the hubs' ranks by broadcast. The mass of nodes without out-edges is counted while their ranks are
    written, one number an iteration. What is kept comes from staged tables, so it can be made again where an executor is lost.
    """
    out = stage(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    nodes = stage(nodes.select("id").distinct().join(out, "id", "left"))
    n, loose = nodes.agg(F.count(F.lit(1)), F.count(F.when(F.col("n").isNull(), 1))).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    shared = edges.select("src", "dst").join(out.select(F.col("id").alias("src"), (1.0 / F.col("n")).alias("share")), "src")
    return _ranks(shared, out, nodes.select("id", F.col("n").isNull().cast("long").alias("loose")), n, loose, damping, iterations)


def pagerank_by_name(calls: DataFrame, targets: DataFrame, *, damping: float = 0.85, iterations: int = 25) -> DataFrame:
    """pagerank() of the graph in which each src of `calls` (src, name) has an edge to each dst of `targets` (name, dst) of the name, each row
    once, over the nodes dst, which have one name each.

    A name's nodes get the same from the same callers, so they have one score: ranks are those of names, whose links have the shares of
    all callers of one name in another. No row a pair is made.
    """
    sizes = stage(targets.groupBy("name").agg(F.count(F.lit(1)).alias("size")))
    n = sizes.agg(F.sum("size")).first()[0]
    if not n:
        return targets.select(F.col("dst").alias("id"), F.lit(0.0).alias("score"))
    out = stage(calls.join(sizes, "name").groupBy("src").agg(F.sum("size").alias("out")))
    own = targets.select(F.col("name").alias("own"), F.col("dst").alias("src"))
    named = stage(own.join(out, "src", "left"))
    loose = named.where(F.col("out").isNull()).groupBy(F.col("own").alias("id")).agg(F.count(F.lit(1)).alias("loose"))
    nodes = stage(sizes.select(F.col("name").alias("id")).join(loose, "id", "left").fillna(0, ["loose"]))
    known = calls.join(sizes, "name", "left_semi").join(named.where(F.col("out").isNotNull()), "src")
    shared = stage(known.groupBy(F.col("own").alias("src"), F.col("name").alias("dst")).agg(F.sum(1.0 / F.col("out")).alias("share")))
    links = stage(shared.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    ranks = _ranks(shared, links, nodes, n, nodes.agg(F.sum("loose")).first()[0], damping, iterations)
    return targets.join(ranks.withColumnRenamed("id", "name"), "name").select(F.col("dst").alias("id"), "score")


def _ranks(shared: DataFrame, out: DataFrame, nodes: DataFrame, n: int, loose: int, damping: float, iterations: int) -> DataFrame:
    """(id, score) after some iterations: `shared` (src, dst, share of src's score), `out` (id, its number n of those), and `nodes` (id, loose,
    how many of the n nodes without out-edges it stands for).
    """
    spark = shared.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = out.agg(F.sum("n")).first()[0] or 0
    hubs = out.where(F.col("n") > max(total // HUB, 1)).select(F.col("id").alias("src"))
    some_hubs = total > HUB and not hubs.isEmpty()
    if some_hubs:
        of_hubs = stage(shared.join(F.broadcast(hubs), "src", "left_semi"))
        shared = shared.join(F.broadcast(hubs), "src", "left_anti")
    # sorted, too, so that only gains are sorted again
    links = shared.repartition(parts, "src").sortWithinPartitions("src").persist()
    nodes = nodes.repartition(parts, "id").sortWithinPartitions("id").persist()
    ranks, mass = nodes.select("id", "loose", F.lit(1.0 / n).alias("score")), loose / n
    for k in range(1, iterations + 1):
        gains = links.join(ranks, links["src"] == ranks["id"]).select("dst", (F.col("score") * F.col("share")).alias("gain"))
        if some_hubs:
            top = F.broadcast(ranks.select(F.col("id").alias("src"), "score").join(F.broadcast(hubs), "src", "left_semi"))
            gains = gains.unionAll(of_hubs.join(top, "src").select("dst", (F.col("score") * F.col("share")).alias("gain")))
        gained = gains.groupBy("dst").agg(F.sum("gain").alias("gain"))
        base = (1.0 - damping) / n + damping * mass / n
        ranks = nodes.join(gained, nodes["id"] == gained["dst"], "left").select("id", "loose", (F.lit(base) + damping * F.coalesce("gain", F.lit(0.0))).alias("score"))
        if loose:
            seen = Observation()
            ranks = stage(ranks.observe(seen, F.coalesce(F.sum(F.col("loose") * F.col("score")), F.lit(0.0)).alias("mass")), rows=n)
            mass = seen.get["mass"]
        elif k % AT_ONCE == 0 or k == iterations:
            ranks = stage(ranks, rows=n)
    links.unpersist()
    nodes.unpersist()
    return ranks.select("id", "score")


def resolve_callees(calls: DataFrame, symbols: DataFrame, confirmed: Column) -> DataFrame:
    """Targets of each call: `calls` (caller, name, ...) against `symbols` (name, id, ...).

    A pair that `confirmed` holds for has weight 1, another with the name 0.5; a caller's name with any confirmed
    target keeps only those; a name without symbols goes to `?::name` at 0.5.
    """
    pairs = calls.join(symbols, "name", "left").withColumn("weight", F.when(F.col("id").isNotNull() & confirmed, 1.0).otherwise(0.5))
    best = F.max("weight").over(Window.partitionBy("caller", "name"))
    kept = pairs.withColumn("best", best).where(F.col("weight") == F.col("best"))
    return kept.groupBy("caller", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("?::"), "name")).alias("target")).agg(F.max("weight").alias("weight"))


def _confirmed(asked: DataFrame, known: DataFrame, key: str, linked: DataFrame | None) -> DataFrame:
    """(name, key, id) of the ids that confirm a call of a name under a key: those of the same key, and of the keys that `linked` names for it."""
    sure = asked.join(known, ["name", key])
    if linked is not None:
        near = asked.join(linked.select(F.col(linked.columns[0]).alias(key), F.col(linked.columns[1]).alias("_other")), key)
        sure = sure.unionByName(near.join(known.withColumnRenamed(key, "_other"), ["name", "_other"]).select("name", key, "id"))
        sure = sure.repartition("name", key).distinct()  # as joins by name and key need it
    return sure


def resolve_links(calls: DataFrame, symbols: DataFrame, key: str, linked: DataFrame | None = None) -> DataFrame:
    """(caller, name, id): what resolve_callees_by() confirms, and a null id where a caller's name means all symbols of the name. Calls are
    distinct, with one key a caller, and so are symbols; so one join by name and key decides both.
    """
    sure = _confirmed(calls.select("name", key).distinct(), symbols.select("name", "id", key), key, linked)
    return calls.join(sure, ["name", key], "left").select("caller", "name", "id")


#: Targets in a row of blocks(), bytes of them that are broadcast, and tasks a core that make rows of them.
BLOCK, SENT, WAVES = 1024, 160 << 20, 8


def blocks(targets: DataFrame, key: str) -> DataFrame:
    """(name, key, targets): the targets of each name and key, which may be null, in arrays of some BLOCK, so that no row grows with the table."""
    sizes = targets.groupBy(F.col("name").alias("_name"), F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    sized = targets.join(sizes, F.col("name").eqNullSafe(F.col("_name")) & F.col(key).eqNullSafe(F.col("_key")))
    place = F.pmod(F.xxhash64("target"), F.ceil(F.col("n") / BLOCK))
    return sized.groupBy("name", key, place.alias("_block")).agg(F.collect_list("target").alias("targets")).drop("_block")


def resolve_callees_by(calls: DataFrame, symbols: DataFrame, key: str, linked: DataFrame | None = None) -> DataFrame:
    """resolve_callees() where equal `key`s confirm, or keys that `linked` (key, other) names for the caller's: `calls`
    (caller, name, key) against `symbols` (name, id, key).

    What confirms is decided once for each name and key, however many callers these have. Calls are shuffled once, by caller and name; of these
    the confirmed keys stay, or one row that stands for all symbols of the name. Rows are as many as a name's callers times its symbols: they
    are made from arrays of finished targets, in tasks with an equal part of the callers, and where ids have one name and key, and callers one
    key a name, no row can come twice, and none is staged or shuffled.
    """
    calls, symbols, spark = calls.select("caller", "name", key), symbols.select("name", "id", key).distinct(), calls.sparkSession
    known = symbols.where(F.col("id").isNotNull())
    sure = known.where(F.col(key).isNotNull()) if linked is None else _confirmed(calls.select("name", key).distinct(), known, key, linked)
    target = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("?::"), "name")).alias("target")
    named = symbols.select("name", F.lit(None).cast(symbols.schema[key].dataType).alias(key), target).distinct()
    held = stage(blocks(sure.select("name", key, target).unionByName(named), key))
    long = F.aggregate("targets", F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t) + 16) + F.octet_length("name") + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
    sent = F.broadcast if (held.agg(F.sum(long)).first()[0] or 0) <= SENT else lambda df: df
    # a null key from here on: not confirmed
    marked = calls.join(sent(held.where(F.col(key).isNotNull()).select("name", key).distinct().withColumn("_sure", F.lit(True))), ["name", key], "left")
    asks = marked.select("caller", "name", F.when(F.col("_sure"), F.col(key)).alias("_asked"))
    asks = asks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism), "caller", "name")
    each = Window.partitionBy("caller", "name").orderBy(F.col("_asked").desc_nulls_last())
    placed = asks.withColumns({"_place": F.row_number().over(each), "_before": F.lag("_asked").over(each)})
    asks = placed.where((F.col("_place") == 1) | (F.col("_asked") != F.col("_before"))).select("caller", "name", "_asked")
    met = asks.join(sent(held.toDF("_name", "_key", "targets")), (F.col("name") == F.col("_name")) & F.col("_asked").eqNullSafe(F.col("_key")), "left")
    each_target = F.explode(F.coalesce("targets", F.array(F.concat(F.lit("?::"), "name")))).alias("target")
    found = met.select("caller", each_target, F.when(F.col("_asked").isNull(), 0.5).otherwise(1.0).alias("weight"))
    ids = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").cast("string").startswith("?::"))
    keys = calls.distinct().groupBy("caller", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if ids.isEmpty() and (linked is None or keys.isEmpty()):
        return found
    return found.groupBy("caller", "target").agg(F.max("weight").alias("weight"))


def resolve_ranked(symbols: DataFrame, name: str, *, hints: list[Column], limit: int = 10) -> DataFrame:
    """Symbols of a name, whatever its case, best first by hints (descending, then id descending)."""
    order = [h.desc() for h in hints] + [F.col("id").desc()]
    found = symbols.where(F.lower("name") == name.lower())
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= limit)


def search_page(nodes: DataFrame, edges: DataFrame, *, where: Column | None = None, min_degree: int | None = None, max_degree: int | None = None, linked_to: DataFrame | None = None, limit: int = 10, offset: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """A page of nodes (id, ...) by degree descending, then id: with degree, in_degree, out_degree and total, the number found.

    `counted` are the edges' degrees, if they are known. `linked_to` (id) keeps nodes that have an edge to one of those ids.
    """
    found = nodes if where is None else nodes.where(where)
    if linked_to is not None:
        sources = edges.join(linked_to.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        found = found.join(sources, "id", "left_semi")
    counts = found.join(degrees(edges) if counted is None else counted, "id", "left").fillna(0, ["in_degree", "out_degree", "degree"])
    if min_degree is not None:
        counts = counts.where(F.col("degree") >= min_degree)
    if max_degree is not None:
        counts = counts.where(F.col("degree") <= max_degree)
    total = counts.count()
    return counts.orderBy(F.col("degree").desc(), "id").offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def hot_paths(symbols: DataFrame, calls: DataFrame, top_n: int = 10) -> DataFrame:
    """(id, complexity, callers, score) of the symbols with the largest complexity times distinct callers."""
    return hottest(symbols, calls.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers")), top_n)


def hottest(symbols: DataFrame, callers: DataFrame, top_n: int = 10) -> DataFrame:
    """hot_paths() where the callers of each id are counted."""
    scored = symbols.select("id", F.coalesce("complexity", F.lit(1)).cast("long").alias("complexity")).join(callers, "id")
    return scored.withColumn("score", F.col("complexity") * F.col("callers")).orderBy(F.col("score").desc(), "id").limit(top_n)


def numbered(names: DataFrame) -> DataFrame:
    """(name, no) of distinct names in their order, from 0: by ranges of names, each in its task, and how many stand before."""
    ranges = stage(names.repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    # a row a range
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return ranges.withColumn("place", place).join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("place")).alias("no"))


def dependency_graph(imports: DataFrame) -> DataFrame:
    """Distinct edges with both ends numbered by name, as a diagram needs them: src, src_no, dst, dst_no."""
    edges = imports.select("src", "dst").distinct()
    named = stage(numbered(edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()))
    return edges.join(named.toDF("src", "src_no"), "src").join(named.toDF("dst", "dst_no"), "dst").select("src", "src_no", "dst", "dst_no")


def contains_edges(levels: list[DataFrame]) -> DataFrame:
    """Parent to child edges of several levels of a hierarchy, each (parent, child)."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("parent is not null").distinct()
