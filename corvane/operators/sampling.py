"""Seeded samplers. Every draw is a function of (seed, row key), so a rerun or a lost task gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.sampling import gumbel_score, key_digest, uniform_index, unit
from corvane.functions.text import word_count
from corvane.operators.skew import first_row, number_rows, rows_at
from corvane.vocab import SECOND_PICK_FRACTION

ROW_KEY = ("command", "source")


def weighted_pick(
    df: DataFrame, by: Sequence[str], log_weight: Column, seed: str, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """One row per group, drawn with probability proportional to exp(log_weight)."""
    score = gumbel_score(log_weight, unit(seed, *row_key))
    return first_row(df, by, [-score])


def sample_fraction(df: DataFrame, fraction: float, seed: str, row_key: Sequence[str]) -> DataFrame:
    """Keep each row with the given probability."""
    return df.where(unit(seed, *row_key) < F.lit(float(fraction)))


def _first_score(seed: str, stream: Column, command: Column, source: Column, text: Column) -> Column:
    u = unit(seed + "/first", stream, command, source)
    return gumbel_score(word_count(text).cast("double"), u)


def _second_score(seed: str, stream: Column, command: Column, source: Column, text: Column) -> Column:
    u = unit(seed + "/second", stream, command, source)
    return gumbel_score(F.log(word_count(text).cast("double")), u)


def _second_wanted(seed: str, stream: Column, command: Column) -> Column:
    return unit(seed + "/fraction", stream, command) < F.lit(SECOND_PICK_FRACTION)


def sample_descriptions(utterances: DataFrame, seed: str, stream: str = "1") -> DataFrame:
    """Length-weighted draw of the descriptions of each command.

    Every command gives one row (weight exp(number of words)); one command in ten gives a second row drawn from its
    remaining descriptions (weight number of words). Which commands these are depends on the command alone, so only
    their rows enter the second aggregation. Different streams are independent draws.
    """
    key = (seed, F.lit(stream), F.col("command"), F.col("source"), F.col("description"))
    first = first_row(utterances, ["command"], [-_first_score(*key)])
    wanted = _second_wanted(*key[:3])
    taken = first.where(wanted).select("command", F.col("source").alias("__taken"))
    rest = utterances.where(wanted).join(taken, "command", "inner").where(F.col("source") != F.col("__taken"))
    second = first_row(rest.drop("__taken"), ["command"], [-_second_score(*key)])
    return first.unionByName(second)


def draw_descriptions(packed: DataFrame, seed: str, streams: Sequence[str]) -> DataFrame:
    """The draws of ``sample_descriptions`` for several streams from commands that carry their descriptions as an
    array ``texts`` of (source, description): a projection, nothing is shuffled."""
    rows = packed.withColumn("stream", F.explode(F.array(*[F.lit(s) for s in streams])))

    def best(texts: Column, score) -> Column:
        def scored(t: Column) -> Column:
            value = -score(seed, F.col("stream"), F.col("command"), t["source"], t["description"])
            return F.struct(value.alias("score"), t["source"].alias("source"), t["description"].alias("description"))

        return F.array_min(F.transform(texts, scored))

    first = rows.withColumn("__first", best(F.col("texts"), _first_score))
    rest = F.filter("texts", lambda t: t["source"] != F.col("__first.source"))
    wanted = _second_wanted(seed, F.col("stream"), F.col("command"))
    second = F.when(wanted & (F.size("texts") > 1), best(rest, _second_score))
    both = first.withColumn("__pick", F.explode(F.array_compact(F.array(F.col("__first"), second))))
    keep = [c for c in packed.columns if c != "texts"]
    return both.select("stream", *keep, F.col("__pick.source").alias("source"), F.col("__pick.description").alias("description"))


def pick_per(df: DataFrame, by: Sequence[str], seed: str, row_key: Sequence[str]) -> DataFrame:
    """One uniform row per group."""
    return first_row(df, by, [key_digest(seed, *row_key)])


def cap_per(df: DataFrame, by: Sequence[str], n: int, seed: str, row_key: Sequence[str]) -> DataFrame:
    """Up to ``n`` uniform rows per group; tasks keep only their own best ``n`` before the shuffle."""
    ranked = W.partitionBy(*by).orderBy(key_digest(seed, *row_key), *row_key)
    return df.withColumn("__r", F.row_number().over(ranked)).where(F.col("__r") <= n).drop("__r")


def pick_n(df: DataFrame, n: int, seed: str, row_key: Sequence[str]) -> DataFrame:
    """``n`` uniform rows of the whole table (a top-n sort, no global window)."""
    return df.orderBy(key_digest(seed, *row_key), *row_key).limit(n)


def resample(
    df: DataFrame, n: int, seed: str, row_key: Sequence[str], out: str = "draw"
) -> DataFrame:
    """``n`` uniform rows with replacement, numbered by ``out`` = 0 .. n-1."""
    draws = df.sparkSession.range(n).select(F.col("id").alias(out))
    index = uniform_index("__total", seed, out)
    return rows_at(df, draws, key_digest("order", *row_key), row_key, index, out)


def resample_per(
    df: DataFrame, by: str, per: int, seed: str, row_key: Sequence[str], out: str = "draw"
) -> DataFrame:
    """``per`` uniform rows with replacement from each group."""
    numbered = number_rows(df, [by], key_digest("order", *row_key), ties=row_key, out="__idx")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.select(by, "__n", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias(out))
    draws = draws.withColumn("__idx", uniform_index("__n", seed, by, out)).drop("__n")
    return draws.join(numbered, [by, "__idx"], "inner").drop("__idx")


def zip_frames(left: DataFrame, right: DataFrame, on: str = "draw") -> DataFrame:
    """Put two numbered frames side by side."""
    return left.join(right, on, "inner")


def shuffle_rows(df: DataFrame, seed: str, row_key: Sequence[str]) -> DataFrame:
    """Seeded global order: a range-partitioned sort."""
    return df.orderBy(key_digest(seed, *row_key), *row_key)


# --- One row per combination of groups, without building the product of the rows -----------------
#
# Rows come as numbered draws ``(stream, role, group, idx, ...)``; ``group_table`` lists their groups.

ROLE = ["stream", "role"]


def number_draws(draws: DataFrame, group: str) -> DataFrame:
    """Draws with their number ``idx`` within (stream, role, group)."""
    digest = key_digest("order", "command", "source")
    return number_rows(draws, [*ROLE, group], digest, ties=["command", "source"])


def group_table(numbered: DataFrame, group: str) -> DataFrame:
    """``(stream, role, group, n, g, n_groups)``: size and number of each group, number of groups."""
    sizes = numbered.groupBy(*ROLE, group).agg(F.count(F.lit(1)).alias("n"))
    return number_rows(sizes, ROLE, F.md5(group), ties=[group], out="g", total="n_groups")


def _groups(groups: DataFrame, group: str, stream: str, role: str, suffix: str) -> DataFrame:
    rows = groups.where((F.col("stream") == stream) & (F.col("role") == role))
    return rows.select(
        F.col(group).alias(f"{group}_{suffix}"),
        F.col("n").alias(f"n_{suffix}"),
        F.col("g").alias(f"g_{suffix}"),
        F.col("n_groups").alias(f"groups_{suffix}"),
    )


def _member(numbered: DataFrame, group: str, stream: str, role: str, suffix: str, columns: Sequence[str]) -> DataFrame:
    rows = numbered.where((F.col("stream") == stream) & (F.col("role") == role))
    return rows.select(
        F.col(group).alias(f"{group}_{suffix}"),
        F.col("idx").alias(f"i_{suffix}"),
        *[F.col(c).alias(f"{c}_{suffix}") for c in columns],
    )


def sampled_pairs(
    numbered: DataFrame, groups: DataFrame, group: str, stream: str, roles: tuple[str, str], seed: str, columns: Sequence[str]
) -> DataFrame:
    """One uniform (left, right) row pair per pair of groups; columns get the suffixes ``_t`` and ``_a``.

    A uniform row of L_a x R_b is a uniform row of L_a next to an independent uniform row of R_b, so only the group
    pairs are formed, and those are the result.
    """
    a, b = f"{group}_t", f"{group}_a"
    left, right = (_groups(groups, group, stream, role, x) for role, x in zip(roles, ("t", "a")))
    # Every left group lists the numbers of all right groups; the right side joins on its number.
    count = right.select("groups_a").limit(1).scalar()
    listed = left.withColumn("__n", count).withColumn("g_a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    keys = listed.join(right, "g_a", "inner").select(
        a,
        b,
        uniform_index("n_t", seed + "/left", a, b).alias("i_t"),
        uniform_index("n_a", seed + "/right", a, b).alias("i_a"),
    )
    out = keys.join(_member(numbered, group, stream, roles[0], "t", columns), [a, "i_t"], "inner")
    return out.join(_member(numbered, group, stream, roles[1], "a", columns), [b, "i_a"], "inner").drop("i_t", "i_a")


ROUNDS = 6


def permuted(df: DataFrame, n: str, seed: str, key: str, names: tuple[str, str]) -> DataFrame:
    """``names`` (a pair of numbers below the column ``n``) replaced by its image under a permutation of all pairs.

    Every value of ``key`` has a permutation of its own: rounds in which one number of the pair is shifted by a draw
    that the other one keys. A round can be undone, so distinct pairs stay distinct at every ``n``.
    """
    for k in range(ROUNDS):
        moved, fixed = (names, names[::-1])[k % 2]
        shift = uniform_index(n, f"{seed}/{k}", key, fixed)
        df = df.withColumn(moved, (F.col(moved) + shift) % F.col(n))
    return df


def permuted_combinations(counted: DataFrame, key: str, cap: int | None, seed: str, out: tuple[str, str]) -> DataFrame:
    """``counted`` with a row for each of min(cap, __n**2) distinct pairs of numbers below ``__n``, uniform for each key.

    The first ``cap`` positions of a keyed permutation of all pairs: the work of a key is its rows, whatever the space.
    Without a cap all pairs are listed.
    """
    first, second = out
    space = F.col("__n") * F.col("__n")
    last = (space if cap is None else F.least(space, F.lit(cap).cast("bigint"))) - 1
    rows = counted.where("__n > 0").withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    rows = rows.withColumns({first: F.expr("__at div __n"), second: F.col("__at") % F.col("__n")}).drop("__at")
    return permuted(rows, "__n", seed, key, out)


def sampled_triples(
    numbered: DataFrame,
    groups: DataFrame,
    group: str,
    streams: tuple[str, str],
    roles: tuple[str, str],
    seed: str,
    cap: int | None,
    columns: Sequence[str],
) -> DataFrame:
    """One uniform row per (left, right, third) group triple, at most ``cap`` triples per left group.

    The pair comes from the first stream, the third row from the second stream in the role of the right one. The
    capped set of (right, third) groups is read off a permutation of all of them, so that neither other sets nor their
    texts are formed. The (left, right) draw does not depend on the third group.
    """
    a, b, c = f"{group}_t", f"{group}_a", f"{group}_b"
    left = _groups(groups, group, streams[0], roles[0], "t")
    right = _groups(groups, group, streams[0], roles[1], "a")
    third = _groups(groups, group, streams[1], roles[1], "b")
    # Every command appears in every stream, so the right and the third side have the same groups.
    count = right.select("groups_a").limit(1).scalar()
    located = permuted_combinations(left.withColumn("__n", count), a, cap, seed + "/cap", ("g_a", "g_b"))
    keys = located.join(right, "g_a", "inner").join(third, "g_b", "inner").select(
        a,
        b,
        c,
        uniform_index("n_t", seed + "/left", a, b).alias("i_t"),
        uniform_index("n_a", seed + "/right", a, b).alias("i_a"),
        uniform_index("n_b", seed + "/third", a, b, c).alias("i_b"),
    )
    out = keys.join(_member(numbered, group, streams[0], roles[0], "t", columns), [a, "i_t"], "inner")
    out = out.join(_member(numbered, group, streams[0], roles[1], "a", columns), [b, "i_a"], "inner")
    out = out.join(_member(numbered, group, streams[1], roles[1], "b", columns), [c, "i_b"], "inner")
    return out.drop("i_t", "i_a", "i_b")
