"""Ways to order, number, cut and join tables without one task holding a whole group.

A window over a user, an item or the whole table puts that group into one task. The
helpers here split a group by a coarse, order-preserving bucket, work inside the pieces,
and connect them through a small table with one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import coarse, key_digest
from ..session import materialize

# Rows of one join key that a single task may hold before the key is split.
JOIN_PIECE = 4096
# Rows of one sequence block (see ``sequence_blocks``).
BLOCK_ROWS = 4096


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
                  value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per group, where a group may be of any size.

    ``bucket`` must be monotone in ``order``. The window over the group sees one row
    per bucket only; the window over the rows sees one bucket of one group only.
    """
    pieces = group + ["_piece"]
    rows = df.withColumn("_piece", bucket).withColumn("_value", value)
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (rows.groupBy(*pieces).agg(F.sum("_value").alias("_total"))
              .select(*pieces, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")))
    within = W.partitionBy(*pieces).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.withColumn("_within", F.sum("_value").over(within))
            .join(starts, pieces)
            .withColumn(out, F.col("_start") + F.col("_within"))
            .drop("_piece", "_value", "_start", "_within"))


def global_index(df: DataFrame, order: list[Column], out: str = "idx") -> DataFrame:
    """0-based position of every row in one global order, by a range-partitioned sort.

    Only one offset per partition meets in one place, never the rows.
    """
    ordered = materialize(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("_part")).count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    # one row per partition of the sort, hence safe to broadcast
    return (ordered.withColumn("_part", part)
            .join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_start", "_row"))


def positions(df: DataFrame, group: list[str], order: list[str], out: str = "pos",
              dense: bool = False) -> DataFrame:
    """1-based position of each row in its group; ``order`` must be unique in the group.

    Time orders are cut by day and ``dense`` orders (numbers without large gaps) by width, so
    the table of pieces stays small. Any other order goes through one range-partitioned sort
    by (group, order), which splits a long group wherever its rows lie.
    """
    lead = df.schema[order[0]].dataType
    if dense or isinstance(lead, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return running_total(df, group, coarse(F.col(order[0]), lead),
                             [F.col(c) for c in order], F.lit(1), out)
    placed = global_index(df, [F.col(c) for c in [*group, *order]], "_place")
    starts = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    return (placed.join(starts, group).withColumn(out, F.col("_place") - F.col("_first") + 1)
            .drop("_place", "_first"))


def sequence_blocks(df: DataFrame, pos: str = "pos", halo: int = 1,
                    block: int = BLOCK_ROWS) -> DataFrame:
    """Cut positioned sequences into blocks; each also gets the ``halo`` rows before it.

    Adds ``block_no`` and ``is_halo``. A window over (group, block_no) then sees the same
    preceding rows as a window over the whole group would.
    """
    if halo > block:
        raise ValueError("a block must be at least as long as its halo")
    zero = F.col(pos) - 1
    own = F.floor(zero / block)
    targets = F.when(zero % block >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("block_no", F.explode(targets))
            .withColumn("is_halo", F.col("block_no") != own))


def first_by_digest(df: DataFrame, keys: list[str], seed: int, n: Column, out: str) -> DataFrame:
    """Flag exactly ``n`` rows, chosen by the digest of their unique ``keys``.

    The n-th smallest digest is found from a histogram of digest prefixes (at most 65,536
    rows) and the one bucket that holds it; the table itself is not sorted or moved.
    """
    digests = df.select(key_digest(*[F.col(k) for k in keys], seed).alias("_digest"))
    hist = digests.groupBy(F.substring("_digest", 1, 4).alias("_prefix")).count()
    upto = W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = hist.select("_prefix", "count", F.sum("count").over(upto).alias("_upto"))
    edge = (hist.where((F.col("_upto") >= n) & (F.col("_upto") - F.col("count") < n))
            .select("_prefix", (n - (F.col("_upto") - F.col("count"))).alias("_need")))
    rank = F.row_number().over(W.partitionBy("_prefix").orderBy("_digest"))
    cut = (digests.withColumn("_prefix", F.substring("_digest", 1, 4))
           .join(F.broadcast(edge), "_prefix")          # a single row
           .withColumn("_rank", rank)
           .where(F.col("_rank") == F.col("_need")).select("_digest"))
    flag = key_digest(*[F.col(k) for k in keys], seed) <= cut.scalar()
    return df.withColumn(out, F.coalesce(flag, n > 0))


def _with_pieces(df: DataFrame, key: list[str], sizes: DataFrame, piece: int) -> DataFrame:
    return (df.join(sizes, key, "left")
            .withColumn("_lp", F.coalesce(F.ceil(F.col("_ln") / piece), F.lit(1)))
            .withColumn("_rp", F.coalesce(F.ceil(F.col("_rn") / piece), F.lit(1))))


def spread_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitioning that adaptive execution keeps: for steps that do much work per byte."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, n: Column, out: str, piece: int = 4096) -> DataFrame:
    """Every row once for each number from 0 to ``n`` - 1 (none for 0).

    Exploded in two steps, so that no array is longer than ``piece`` or ``n`` / ``piece``.
    """
    parts = df.withColumn("_n", n.cast("bigint")).where("_n > 0")
    parts = parts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / piece))))
    first = F.col("_part") * piece
    return parts.withColumn(out, F.explode(F.sequence(first, F.least("_n", first + piece) - 1))).drop("_n", "_part")


def split_join(left: DataFrame, right: DataFrame, key: list[str],
               left_sizes: DataFrame | None = None, right_sizes: DataFrame | None = None,
               piece: int = JOIN_PIECE) -> DataFrame:
    """Many-to-many equi join in which a hot key is shared out over many tasks.

    Rows of a key with more than ``piece`` rows on a side are dealt into pieces; every
    piece of the left meets every piece of the right exactly once, so the result is
    that of a plain join while no task holds more than piece x piece pairs of a key.
    ``*_sizes`` (key + ``n``) may give cheap upper bounds instead of counting.
    """
    ln = left.groupBy(*key).agg(F.count("*").alias("n")) if left_sizes is None else left_sizes
    rn = right.groupBy(*key).agg(F.count("*").alias("n")) if right_sizes is None else right_sizes
    hot_l = ln.where(F.col("n") > piece).select(*key, F.col("n").alias("_ln"))
    hot_r = rn.where(F.col("n") > piece).select(*key, F.col("n").alias("_rn"))
    hot = hot_l.join(hot_r, key, "full")
    skip = {*key}
    deal_l = F.xxhash64(*[c for c in left.columns if c not in skip])
    deal_r = F.xxhash64(*[c for c in right.columns if c not in skip])
    lhs = (_with_pieces(left, key, hot, piece)
           .withColumn("_i", F.pmod(deal_l, F.col("_lp")))
           .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rp") - 1)))
           .drop("_ln", "_rn", "_lp", "_rp"))
    rhs = (_with_pieces(right, key, hot, piece)
           .withColumn("_j", F.pmod(deal_r, F.col("_rp")))
           .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lp") - 1)))
           .drop("_ln", "_rn", "_lp", "_rp"))
    # A few input bytes can become many pairs, so the partition count is set, not derived
    # from input size, and neither side is broadcast; hot keys are already dealt out.
    on = key + ["_i", "_j"]
    return spread_out(lhs, on).hint("merge").join(spread_out(rhs, on), on).drop("_i", "_j")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1,
                    rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group. Spark drops the rest before the shuffle."""
    col = rank or "_rank"
    w = W.partitionBy(*group).orderBy(*order)
    out = df.withColumn(col, F.row_number().over(w)).where(F.col(col) <= n)
    return out if rank else out.drop(col)
