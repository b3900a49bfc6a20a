"""Building blocks that keep hot keys out of single tasks.

* ``number_rows``     row numbers within groups of any size: the group is cut by digest prefix, numbered per
                      slice, and the slices are joined by running totals of their (small) counts.
* ``first_row``       one row per group as an aggregate with map-side combine, never a window over the group.
* ``tiled_pairs``     self pairing within groups where every group is cut into tiles of bounded size.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALT_ROWS = 1 << 20  # rows of one key that one task of a join with an aggregate by that key takes
PREFIX = 4  # hex digits of a digest that name a slice of a group: up to 65,536 slices


def configure(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split hot join keys even when that costs one more shuffle, and keep short tables of
    costly rows on more than one core."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the session names; a lost executor costs no recomputation.

    Without a folder a session on one machine gets a temporary one; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="corvane-")
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """First (or last) row of each group by ``order``; ties fall to the smallest (largest) row."""
    rest = [c for c in df.columns if c not in by]
    ordered = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    picked = df.groupBy(*by).agg((F.max if last else F.min)(ordered).alias("__row"))
    return picked.select(*[c if c in by else F.col(f"__row.{c}").alias(c) for c in df.columns])


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    digest: Column,
    ties: Sequence[str | Column] = (),
    out: str = "idx",
    total: str | None = None,
    prefix: int = PREFIX,
) -> DataFrame:
    """Zero-based number of each row in its group, ordered by ``digest`` and then ``ties``.

    The rows of a null group are one group. The leading ``prefix`` hex digits of the digest cut a group into up to
    ``16**prefix`` slices, which are numbered on their own. Only the slice sizes meet in one window, and they are
    bounded by ``16**prefix`` per group. Rows and slice sizes come from the same shuffle.
    """
    by = list(by)
    keys = by + ["__slice"]
    cut = df.withColumn("__digest", digest).withColumn("__slice", F.substring("__digest", 1, prefix))
    inner = W.partitionBy(*keys).orderBy("__digest", *ties)
    whole = inner.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = cut.withColumns({"__rank": F.row_number().over(inner), "__n": F.count(F.lit(1)).over(whole)})
    slices = ranked.where(F.col("__rank") == 1).select(*keys, "__n")
    # One group only: the window has no key, and at most 16**prefix rows.
    scope = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    running = scope.orderBy("__slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = slices.withColumn("__before", F.sum("__n").over(running) - F.col("__n"))
    if total:
        offsets = offsets.withColumn(total, F.sum("__n").over(scope))
    # Null-safe, so that rows of a null group are numbered as well.
    offsets = offsets.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], *[c for c in offsets.columns if c not in [*keys, "__n"]])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__o{i}")) for i, k in enumerate(keys)])
    joined = ranked.drop("__n").join(offsets, same, "inner").drop(*[f"__o{i}" for i in range(len(keys))])
    return joined.withColumn(out, (F.col("__before") + F.col("__rank") - 1).cast("bigint")).drop(
        "__digest", "__slice", "__before", "__rank"
    )


def running_starts(sizes: DataFrame, name: str, n: str, head: int) -> DataFrame:
    """``sizes`` (one row a hex name) with ``__start``, the sum of the sizes of all smaller names.

    Names that share their first ``head`` digits are summed in one task; only the sums of these meet in a single one.
    """
    group = F.substring(name, 1, head)
    before = lambda w, c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(c)
    inner = sizes.withColumn("__head", group).withColumn("__in", before(W.partitionBy("__head").orderBy(name), n))
    heads = sizes.groupBy(group.alias("__head")).agg(F.sum(n).alias("__sum"))
    heads = heads.select("__head", before(W.partitionBy(F.lit(0)).orderBy("__head"), "__sum").alias("__base"))
    joined = inner.join(F.broadcast(heads), "__head")
    return joined.withColumn("__start", (F.col("__in") + F.col("__base")).cast("bigint")).drop("__head", "__in", "__base")


def rows_at(
    df: DataFrame, draws: DataFrame, digest: Column, ties: Sequence[str], index: Column, out: str, prefix: int = PREFIX
) -> DataFrame:
    """Rows of the whole table at the drawn positions of the order of ``number_rows``.

    ``index`` is computed over the columns of ``draws`` and ``__total``, the number of rows. ``draws`` is a table of any
    size with the number ``out``. Only the slices that a position falls into are moved and numbered.
    """
    cut = df.withColumn("__digest", digest).withColumn("__slice", F.substring("__digest", 1, prefix))
    sizes = cut.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # A slice covers a range of positions. Ranges and positions meet by bins of equal width, about as many as slices, so
    # that the bins of all ranges are at most 2 * 16**prefix rows, however many positions are drawn.
    width = F.greatest(F.ceil(F.col("__total") / F.lit(float(16**prefix))).cast("bigint"), F.lit(1))
    binned = lambda c: F.floor(c / F.col("__width")).cast("bigint")
    ranges = running_starts(sizes, "__slice", "__n", prefix // 2).withColumn("__total", total).withColumn("__width", width)
    covered = F.sequence(binned(F.col("__start")), binned(F.col("__start") + F.col("__n") - 1))
    bins = ranges.select("__slice", "__start", "__n", F.explode(covered).alias("__bin"))
    wanted = draws.withColumn("__total", total).select(F.col(out).cast("bigint").alias(out), index.alias("__at"), width.alias("__width"))
    found = wanted.withColumn("__bin", binned(F.col("__at"))).join(F.broadcast(bins), "__bin")
    inside = (F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__start") + F.col("__n"))
    placed = found.where(inside).select(out, "__slice", (F.col("__at") - F.col("__start") + 1).alias("__rank"))
    hit = cut.join(placed.select("__slice").distinct(), "__slice", "left_semi")
    inner = W.partitionBy("__slice").orderBy("__digest", *ties)
    ranked = hit.withColumn("__rank", F.row_number().over(inner).cast("bigint"))
    return ranked.join(placed, ["__slice", "__rank"], "inner").drop("__slice", "__rank", "__digest")


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = SALT_ROWS) -> DataFrame:
    """``(keys..., __salts)`` of the keys with more than ``rows`` rows, one salt for each ``rows`` of them.

    The counts combine on the map side. There are fewer than one such key for ``rows`` rows of the table.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > rows).select(*keys, F.ceil(F.col("__n") / F.lit(rows)).cast("int").alias("__salts"))


def salted_join(df: DataFrame, small: DataFrame, keys: Sequence[str], row_key: Sequence[str], rows: int = SALT_ROWS) -> DataFrame:
    """Inner join with a table of one row a key: the rows of a hot key are spread over as many tasks as its count asks for.

    An aggregate by the join key is no shuffle of its own that adaptive execution could split, so hot keys of the large
    side are split here, and their row of the other side is copied once for each salt. Cold keys are joined as they are.
    """
    hot = F.broadcast(hot_keys(df, keys, rows))
    salts = F.coalesce("__salts", F.lit(1))
    own = F.pmod(F.xxhash64(*row_key), salts).cast("int")
    left = df.join(hot, list(keys), "left").withColumn("__salt", own).drop("__salts")
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    right = small.join(hot, list(keys), "left").withColumn("__salt", copies).drop("__salts")
    return left.join(right, [*keys, "__salt"], "inner").drop("__salt")


def tiled_pairs(
    df: DataFrame, key: str, row_key: Sequence[str], residual, tile: int = 2000, suffixes=("_a", "_b")
) -> DataFrame:
    """All ordered pairs of rows that share ``key`` and satisfy ``residual(left, right)``.

    A group of n rows is cut into ``ceil(n / tile)`` blocks; each row goes to one block and meets the blocks of the
    other side, so no task sees more than about tile x tile pairs of one group at a time.
    """
    sizes = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
        .select(key, F.ceil(F.col("__n") / F.lit(tile)).cast("int").alias("__blocks"))
    )
    sized = salted_join(df, sizes, [key], row_key)
    block = F.pmod(F.xxhash64(*row_key), F.col("__blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("__blocks") - 1)
    value_cols = [c for c in df.columns if c != key]

    def side(suffix: str, own: str, other: str) -> DataFrame:
        return sized.select(
            F.col(key),
            *[F.col(c).alias(c + suffix) for c in value_cols],
            block.alias(own),
            F.explode(others).alias(other),
        )

    left = side(suffixes[0], "__lb", "__rb")
    right = side(suffixes[1], "__rb", "__lb")
    return left.join(right, [key, "__lb", "__rb"], "inner").where(residual).drop("__lb", "__rb")
