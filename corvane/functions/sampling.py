"""Seeded pseudo-random columns: pure functions of (seed, row key), the same in every engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest_sql(seed: str, names: Sequence[str]) -> str:
    keys = ", ".join(f"cast({name} as string)" for name in names)
    return f"md5(concat_ws('|', {_sql(seed)}, {keys}))"


def _unit_sql(digest: str) -> str:
    return f"((cast(conv(substring({digest}, 1, 13), 16, 10) as bigint) + 0.5D) / 4503599627370496.0D)"


def key_digest(seed: str, *keys: Column | str) -> Column:
    """Hex digest of the seed and the key columns, nulls skipped."""
    if all(isinstance(k, str) for k in keys):
        return F.expr(_digest_sql(seed, keys))
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.md5(F.concat_ws("|", *parts))


def unit(seed: str, *keys: Column | str) -> Column:
    """Uniform number in (0, 1) for a row key, from the first 13 hex digits (52 bits) of its digest."""
    if all(isinstance(k, str) for k in keys):
        return F.expr(_unit_sql(_digest_sql(seed, keys)))
    head = F.conv(F.substring(key_digest(seed, *keys), 1, 13), 16, 10).cast("bigint")
    return (head + F.lit(0.5)) / F.lit(4503599627370496.0)


def uniform_index(n: str, seed: str, *keys: str) -> Column:
    """Uniform index in 0 .. n-1 for a row key."""
    return F.expr(f"cast(floor({_unit_sql(_digest_sql(seed, keys))} * {n}) as bigint)")


def below_sql(share: float, seed: str, *keys: str) -> str:
    """SQL condition that holds for a share of the row keys."""
    return f"({_unit_sql(_digest_sql(seed, keys))} < {float(share)}D)"


def gumbel_score(log_weight: Column, u: Column) -> Column:
    """Score whose maximum picks a row with probability proportional to exp(log_weight)."""
    return log_weight - F.log(-F.log(u))


def choice(u: Column, outcomes: Sequence[Column], edges: Sequence[float]) -> Column:
    """Outcome i where edges[i-1] <= u < edges[i]; the last outcome covers the rest."""
    expr = None
    for edge, outcome in zip(edges, outcomes):
        cond = u < F.lit(float(edge))
        expr = F.when(cond, outcome) if expr is None else expr.when(cond, outcome)
    return outcomes[-1] if expr is None else expr.otherwise(outcomes[-1])
