"""The user-item graph: adjacency, walks with restart, expected visits, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import key_digest
from ..session import materialize
from .spread import first_per_group, global_index, positions, split_join, spread_out

# Walk chains per item, steps per chain, restart probability, neighbourhood
# size and the deepest rank that is kept.
N_WALKS, WALK_LEN, RESTART = 1000, 10, 0.5
TOP_T, MAX_RANK = 50, 2000
# Draws are 32 bits wide; the odd strides give the rows made from one draw numbers far apart.
WORD, STRIDE, STRIDE_2 = 2 ** 32, 2654435761, 2246822519
# Up to so many edges are sent to all tasks in every step of a walk: twice a step, some 10 MB at most.
FEW_EDGES = 600_000


def adjacency(pairs: DataFrame, by: str) -> DataFrame:
    """node, pos, nbr, deg, nbr_deg: the sorted neighbours of one side, one row each.

    ``pairs`` are distinct (user_id, item_id). A neighbour is addressed by (node, pos), a
    unique key, so a hot node is neither one array nor one task.
    """
    other = "user_id" if by == "item_id" else "item_id"
    deg = pairs.groupBy(by).agg(F.count("*").alias("deg"))
    nbr_deg = pairs.groupBy(other).agg(F.count("*").alias("nbr_deg"))
    return (positions(pairs.select(by, other), [by], [other]).join(deg, by).join(nbr_deg, other)
            .select(F.col(by).alias("node"), "pos", F.col(other).alias("nbr"), "deg", "nbr_deg"))


def _part(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")


def _dealt(rows: DataFrame, n: str, deg: str, first: str, place: str, share: str) -> DataFrame:
    """``n`` walkers of a row dealt evenly over places 1..deg, from a drawn number 0 <= ``first`` < deg.

    Walker j stands at j * deg + first on a line of n * deg numbers, n of them a place. Over all draws a
    place expects n / deg walkers, and each time it gets that number rounded down or up. A row makes at most
    min(n, deg) rows, none without a walker.
    """
    rows = rows.withColumn("_k", F.explode(F.expr(f"sequence(0L, least({n}, {deg}) - 1)")))
    few = f"{n} < {deg}"
    return rows.withColumns({
        place: F.expr(f"if({few}, (_k * {deg} + {first}) div {n}, _k) + 1"),
        share: F.expr(f"if({few}, 1L, ((_k + 1) * {n} - {first} + {deg} - 1) div {deg} - (_k * {n} - {first} + {deg} - 1) div {deg})")})


def _numbered_edges(pairs: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(edge and its pair; node, first, deg): edges numbered by (``by`` node, neighbour), so that place p of a node is
    edge first + p - 1, one number that is unique in the whole graph."""
    other = "user_id" if by == "item_id" else "item_id"
    placed = global_index(pairs.select(by, other), [F.col(by), F.col(other)], "edge")
    return placed, placed.groupBy(by).agg(F.min("edge").alias("first"), F.count("*").alias("deg"))


def _met(rows: DataFrame, hop: DataFrame, n_edges: int) -> DataFrame:
    """Walkers meet the edges they take, one each. Edges are sent to every task only where they are few: every step
    sends them again, so all steps together pass a bounded amount through the driver."""
    if n_edges <= FEW_EDGES:
        return rows.join(F.broadcast(hop), "edge")
    return spread_out(rows, ["edge"]).join(spread_out(hop, ["edge"]).hint("shuffle_hash"), "edge")


def random_walks(pairs: DataFrame, n: int = N_WALKS, length: int = WALK_LEN, restart: float = RESTART,
                 seed: int = 42) -> DataFrame:
    """src, dst, visits of ``n`` chains per item over two-hop steps with restart.

    Walkers are counted, not listed: a row holds how many chains of a source stand at an item. They are dealt
    evenly over the neighbours from a drawn start, so every single chain walks uniformly while the chains of one
    row spread out: the expected visits are those of independent chains, with less noise. A visit counts before
    the restart is drawn. Draws are digests of (source, item, step, seed), so a retried task walks the same way.
    An item without users reaches nothing and has no row. Walkers meet the edges on the edge's number: the load of a
    popular node is spread over its neighbours, and a source never has more than ``n`` rows. What moves is the source,
    the edge, the count and what is left of the draws; restarts are summed over the stored step.
    """
    if n < 1:
        raise ValueError("at least one chain is needed")
    spark = pairs.sparkSession
    pairs = materialize(pairs.select("user_id", "item_id"), "pairs")
    n_edges = pairs.count()
    (by_item, items), (by_user, users) = (_numbered_edges(pairs, by) for by in ("item_id", "user_id"))
    to_user = materialize(by_item.join(items, "item_id").join(users.toDF("user_id", "u_first", "u_deg"), "user_id")
                          .select("edge", "item_id", "first", "deg", "u_first", "u_deg"), "to_user")
    to_item = materialize(by_user.join(items, "item_id").select("edge", F.col("item_id").alias("cur"), "first", "deg"), "to_item")
    hop_user = to_user.select("edge", "u_first", "u_deg")
    sources = to_user.where("edge = first").select(F.col("item_id").alias("src"), "first", "deg")
    threads = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_home = sources.withColumn("n", F.lit(n).cast("bigint"))
    columns = ["src", "cur", "first", "deg", "n"]
    away, steps = None, []
    for step in range(length):
        # few rows with much work each: their partitions are set, not derived from their bytes or an earlier join
        state = at_home.repartition(threads, F.col("src") if away is None else F.xxhash64("src")).withColumn("cur", F.col("src")).select(columns)
        state = state if away is None else state.unionByName(away)
        digest = key_digest(F.col("src"), F.col("cur"), step, seed)
        rows = state.where("n > 0").withColumn("_d", digest).withColumns(
            {f"d{i}": _part(F.col("_d"), i) for i in range(3)}).drop("_d").withColumn("f1", F.col("d0") % F.col("deg"))
        rows = _dealt(rows, "n", "deg", "f1", "p1", "n1").select(
            "src", F.expr("first + p1 - 1").alias("edge"), "n1",
            F.expr(f"(d1 + p1 * {STRIDE}) % {WORD}").alias("x1"), F.expr(f"(d2 + p1 * {STRIDE}) % {WORD}").alias("x2"))
        rows = _met(rows, hop_user, n_edges).withColumn("f2", F.expr("x1 % u_deg"))
        rows = _dealt(rows, "n1", "u_deg", "f2", "p2", "n2").select(
            "src", F.expr("u_first + p2 - 1").alias("edge"), "n2",
            F.expr(f"(n2 * {int(restart * WORD)} + (x2 + p2 * {STRIDE_2}) % {WORD}) div {WORD}").alias("back"))
        here = materialize(_met(rows, to_item, n_edges).groupBy("src", "cur").agg(
            F.max("first").alias("first"), F.max("deg").alias("deg"), F.sum("n2").alias("visits"), F.sum("back").alias("back")),
            "walkers")
        steps.append(here.select("src", F.col("cur").alias("dst"), "visits"))
        left = F.col("visits") - F.col("back")
        home = here.groupBy("src").agg(F.sum(F.when(F.col("cur") == F.col("src"), F.col("visits")).otherwise(F.col("back"))).alias("n"))
        at_home = home.join(sources.hint("shuffle_hash"), "src").select("src", "first", "deg", "n")
        away = here.where("cur <> src").withColumn("n", left).select(columns)
    return reduce(DataFrame.unionByName, steps).groupBy("src", "dst").agg(F.sum("visits").alias("visits"))


def expected_visits(pairs: DataFrame, length: int = WALK_LEN, restart: float = RESTART,
                    sources: DataFrame | None = None) -> DataFrame:
    """src, dst, mass: the expectation of the visits of one chain, by power iteration.

    From all items the first step's visits are the matrix of two hops. Where it has no more entries than the hops
    have edges, as in a dense graph, later steps multiply by it and never meet the users again.
    """
    edges = materialize(pairs.select("user_id", "item_id"), "edges")
    by_item = edges.groupBy("item_id").agg(F.count("*").alias("n"))
    by_user = edges.groupBy("user_id").agg(F.count("*").alias("n"))
    to_user = edges.join(by_item, "item_id").select("item_id", "user_id", (1.0 / F.col("n")).alias("w"))
    to_item = edges.join(by_user, "user_id").select("user_id", "item_id", (1.0 / F.col("n")).alias("w"))
    src = edges.select("item_id").distinct() if sources is None else sources.select("item_id").distinct()
    origin = src.select(F.col("item_id").alias("src"), "item_id", F.lit(1.0).alias("mass"))
    state, steps, two_hops = origin, [], None
    for step in range(length):
        if two_hops is None:
            # a popular node holds a mass row for each source: both sides of its join are dealt out
            at_user = (split_join(state, to_user, ["item_id"], None, by_item)
                       .groupBy("src", "user_id").agg(F.sum(F.col("mass") * F.col("w")).alias("mass")))
            visit = (split_join(at_user, to_item, ["user_id"], None, by_user)
                     .groupBy("src", "item_id").agg(F.sum(F.col("mass") * F.col("w")).alias("mass")))
        else:
            visit = (split_join(state.withColumnRenamed("item_id", "_from"), two_hops, ["_from"])
                     .groupBy("src", "item_id").agg(F.sum(F.col("mass") * F.col("w")).alias("mass")))
        visit = materialize(visit, "visits")
        steps.append(visit)
        if step == 0 and sources is None and visit.count() <= 2 * edges.count():
            two_hops = visit.select(F.col("src").alias("_from"), "item_id", F.col("mass").alias("w"))
        state = (visit.select("src", "item_id", (F.col("mass") * (1 - restart)).alias("mass"))
                 .unionByName(origin.withColumn("mass", F.lit(restart)))
                 .groupBy("src", "item_id").agg(F.sum("mass").alias("mass")))
    return (reduce(DataFrame.unionByName, steps).groupBy("src", F.col("item_id").alias("dst"))
            .agg(F.sum("mass").alias("mass")))


def ranked_visits(visits: DataFrame, weight: str = "visits", max_rank: int = MAX_RANK) -> DataFrame:
    """src, dst, weight, rank without the source itself: most visited first, then item id."""
    order = [F.col(weight).desc(), F.col("dst").asc()]
    return first_per_group(visits.where(F.col("src") != F.col("dst")), ["src"], order, max_rank, rank="rank")


def reached(visits: DataFrame, items: DataFrame) -> DataFrame:
    """src, n_hit: distinct other items each item's walks reached."""
    hits = visits.where(F.col("src") != F.col("dst")).groupBy("src").agg(F.count("*").alias("n_hit"))
    return (items.select(F.col("item_id").alias("src")).join(hits, "src", "left")
            .select("src", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit")))


def neighborhood(visits: DataFrame, items: DataFrame, top: int = TOP_T) -> DataFrame:
    """src, dst, rank, alpha: the ``top`` most visited items with weights that sum to 1.

    An item that reaches nothing gets itself with weight 1.
    """
    best = ranked_visits(visits, max_rank=top)
    total = best.groupBy("src").agg(F.sum("visits").alias("_t"))        # at most ``top`` rows each
    found = best.join(total, "src").select(
        "src", "dst", "rank", (F.col("visits") / F.greatest(F.col("_t"), F.lit(1e-12))).alias("alpha"))
    loops = (reached(visits, items).where("n_hit = 0")
             .select("src", F.col("src").alias("dst"), F.lit(1).alias("rank"), F.lit(1.0).alias("alpha")))
    return found.unionByName(loops)


def khop(nbr: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop: nodes within ``hops`` steps of the seeds, with the smallest number of steps."""
    edges = nbr.select(F.col("src").alias("node"), "dst").distinct()
    known = materialize(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hops")
    for hop in range(1, hops + 1):
        frontier = known.where(F.col("hop") == hop - 1).select("node")
        fresh = (edges.join(frontier, "node", "left_semi").select(F.col("dst").alias("node")).distinct()
                 .join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        known = materialize(known.unionByName(fresh), "hops")
    return known


def walk_fidelity(visits: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """k, overlap, mass_covered: how well the walked top-k matches the expected one."""
    walked = ranked_visits(visits, max_rank=max(ks)).select("src", "dst", F.col("rank").alias("rw"))
    exact = expected.where(F.col("src") != F.col("dst")).select("src", "dst", F.round("mass", 9).alias("mass"))
    exact = materialize(exact, "exact")
    top = ranked_visits(exact, "mass", max(ks)).select("src", "dst", F.col("rank").alias("re"))
    both = (exact.join(walked, ["src", "dst"], "left").join(top, ["src", "dst"], "left"))
    aggs = []
    for k in ks:
        aggs.append(F.count_if((F.col("rw") <= k) & (F.col("re") <= k)).alias(f"o{k}"))
        aggs.append(F.count_if(F.col("re") <= k).alias(f"n{k}"))
        aggs.append(F.sum(F.when(F.col("rw") <= k, F.col("mass")).otherwise(0.0)).alias(f"m{k}"))
    per_src = both.groupBy("src").agg(F.sum("mass").alias("total"), *aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), (F.col(f"o{k}") / F.col(f"n{k}")).alias("o"),
        (F.col(f"m{k}") / F.col("total")).alias("m")) for k in ks]))
    return (per_src.select(rows.alias("r")).groupBy("r.k")
            .agg(F.avg("r.o").alias("overlap"), F.avg("r.m").alias("mass_covered")))
