"""Nearest neighbours.

Exact search cuts both sides into blocks of bounded size; two blocks are a tile. A tile is a series of matrix products in
single precision that leave a few candidates to measure, and only the best ``k`` rows of each query leave it; a last
ranking joins the tiles of a query. Groups (a tag, a parent element, a hash bucket) are
join keys; a large group becomes as many tiles as it needs, and many small groups share one, with a product each. Few queries against a large corpus take the
streaming path instead: they are sent to every task after their number has been checked, and the corpus is not moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.vectors import unit_rows
from corvane.operators.skew import salted_join

TILE = 4096
DIGITS = 9  # distances are rounded before ranking, so that the order does not hang on the order of additions
VALUES = 1 << 22  # numbers in the vectors of one side of a tile
SPREAD = 8  # blocks that a small table is cut into
_BLOCK = 1 << 20  # cells of a product
_LISTS = 1 << 13  # queries whose lists of groups are laid out at a time
_PAIRS = 1 << 16  # pairs that are measured in doubles at a time
_HELD = 1 << 21  # candidates that are held before they are cut to the best


def _distances(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded distances of pairs of rows, in doubles."""
    out = np.empty(len(rows))
    for start in range(0, len(rows), _PAIRS):
        part = slice(start, start + _PAIRS)
        out[part] = np.einsum("ij,ij->i", unit_rows(q[rows[part]]), unit_rows(c[cols[part]]))
    return np.round(1.0 - out, DIGITS) + 0.0


class _Nearest:
    """The candidates of the queries of a tile that can be among their ``k`` nearest.

    A product in single precision leaves out what is farther than a query's ``k``-th distance so far (or than ``most``, a
    distance that is known before) by more than its error can be; only the rest is measured in doubles.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray | None) -> None:
        self.q, self.c, self.ids, self.k = q, c, ids, k
        self.q4, self.c4 = unit_rows(q).astype(np.float32), -unit_rows(c).astype(np.float32)
        self.slack = 2 * (q.shape[1] + 4) * 2.0**-24 + 2 * 10.0**-DIGITS
        self.most = np.full(len(q), np.inf) if most is None else np.where(np.isnan(most), np.inf, most)
        self.best = np.full((len(q), k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def compare(self, rows: np.ndarray, start: int, stop: int, tile: int, runs: np.ndarray | None = None) -> None:
        """Meet some queries with the candidate rows from ``start`` to ``stop``.

        With ``runs`` (first row of each run of rows of one candidate) a candidate is as near as its nearest row, and is
        known by its first row.
        """
        firsts = np.arange(start, stop) if runs is None else runs
        edges = np.append(firsts[::tile], stop)
        for left, right in zip(edges[:-1], edges[1:]):
            heads = firsts[np.searchsorted(firsts, left) : np.searchsorted(firsts, right)]
            step = max(1, _BLOCK // (right - left))
            for at in range(0, len(rows), step):
                self._block(rows[at : at + step], left, right, None if runs is None else heads)

    def _block(self, rows: np.ndarray, left: int, right: int, heads: np.ndarray | None) -> None:
        if heads is None and right - left <= 4 * self.k:  # nearly all are measured
            dist = np.round(1.0 - unit_rows(self.q[rows]) @ unit_rows(self.c[left:right]).T, DIGITS) + 0.0
            at, cols = np.nonzero(dist <= self.most[rows][:, None])
            return self._keep(rows, at, cols + left, dist[at, cols])
        near = self.q4[rows] @ self.c4[left:right].T  # minus the cosine
        if heads is not None:
            near = np.minimum.reduceat(near, heads - left, axis=1)
        limit = self.most[rows] - 1.0
        if near.shape[1] >= self.k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        at, cols = np.nonzero(near <= (limit + self.slack).astype(np.float32)[:, None])
        if len(at):
            self._add(rows, at, cols + left if heads is None else heads[cols], right, heads)

    def _add(self, rows: np.ndarray, at: np.ndarray, cols: np.ndarray, right: int, heads: np.ndarray | None) -> None:
        if heads is None:
            dist = _distances(self.q, self.c, rows[at], cols)
        else:
            ends = np.append(heads[1:], right)
            size = ends[np.searchsorted(heads, cols)] - cols
            first = np.cumsum(size) - size
            every = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(cols, size)
            dist = np.minimum.reduceat(_distances(self.q, self.c, np.repeat(rows[at], size), every), first)
        keep = dist <= self.most[rows[at]]
        self._keep(rows, at[keep], cols[keep], dist[keep])

    def _keep(self, rows: np.ndarray, at: np.ndarray, cols: np.ndarray, dist: np.ndarray) -> None:
        if not len(at):
            return
        # The distances of each query's new candidates as a matrix, beside the best ones so far.
        own, first, count = np.unique(at, return_index=True, return_counts=True)
        wide = np.full((len(own), count.max()), np.inf)
        wide[np.repeat(np.arange(len(own)), count), np.arange(len(at)) - np.repeat(first, count)] = dist
        both = np.partition(np.hstack([self.best[rows[own]], wide]), self.k - 1, axis=1)[:, : self.k]
        self.best[rows[own]] = both
        self.most[rows[own]] = np.minimum(self.most[rows[own]], both[:, -1])
        self.found.append((rows[at], cols, dist))
        self.held += len(at)
        if self.held > _HELD:
            self.found = [self.top()]
            self.held = len(self.found[0][0])

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate row, distance) of the k nearest candidates, ties by candidate id."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, cols, dist = (np.concatenate(x) for x in zip(*self.found))
        keep = dist <= self.most[rows]
        rows, cols, dist = rows[keep], cols[keep], dist[keep]
        order = np.lexsort((self.ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        first = np.searchsorted(rows, np.arange(len(self.q)))
        keep = np.arange(len(rows)) - first[rows] < self.k
        return rows[keep], cols[keep], dist[keep]


def _groups(queries: pd.DataFrame, corpus: pd.DataFrame, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of both frames' rows."""
    if not keys:
        return np.zeros(len(queries), np.int64), np.zeros(len(corpus), np.int64)
    both = pd.concat([queries[list(keys)], corpus[list(keys)]], ignore_index=True)
    number = both.groupby(list(keys), sort=False).ngroup().to_numpy()
    return number[: len(queries)], number[len(queries) :]


def _tile_top(
    queries: pd.DataFrame,
    corpus: pd.DataFrame,
    keys: Sequence[str],
    k: int,
    carry: Sequence[str],
    collapse: bool = False,
    most: str | None = None,
    member: str | None = None,
    tile: int = TILE,
) -> pd.DataFrame:
    """The best ``k`` of each query within its own group; a tile may hold many small groups."""
    names = ["query_id", "item_id", "distance", *carry]
    if queries.empty or corpus.empty:
        return pd.DataFrame(columns=names)
    # With ``member`` a query names several groups, so the lists of some queries at a time are laid out.
    parts = [slice(None)] if member is None else [slice(i, i + _LISTS) for i in range(0, len(queries), _LISTS)]
    if member is None:
        of_query, of_item = _groups(queries, corpus, keys)
    else:
        of_item = corpus[member].to_numpy()
    order = np.lexsort((corpus["item_id"].to_numpy(), of_item)) if collapse else np.argsort(of_item, kind="stable")
    corpus, of_item = corpus.iloc[order], of_item[order]
    ids = corpus["item_id"].to_numpy()
    ranks = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]  # texts by their order
    limits = None if most is None else queries[most].to_numpy(dtype=np.float64)
    nearest = _Nearest(np.stack(queries["query_vec"].to_numpy()), np.stack(corpus["item_vec"].to_numpy()), ranks, k, limits)
    for part in parts:
        asks = np.arange(len(queries))[part]
        if member is not None:
            lists = queries[member].iloc[part]
            asks, of_query = np.repeat(asks, lists.str.len().to_numpy(dtype=np.int64)), np.concatenate(lists.to_list())
        order = np.argsort(of_query, kind="stable")
        asks, asked = asks[order], of_query[order]
        shared = np.intersect1d(asked, of_item)
        edges = [np.searchsorted(x, shared, side) for x in (asked, of_item) for side in ("left", "right")]
        for a, b, u, v in zip(*edges):
            runs = None
            if collapse:
                runs = u + np.flatnonzero(np.append(True, ids[u + 1 : v] != ids[u : v - 1]))
                runs = None if len(runs) == v - u else runs
            nearest.compare(asks[a:b], u, v, tile, runs)
    rows, cols, dist = nearest.top()
    part = {"query_id": queries["query_id"].to_numpy()[rows], "item_id": ids[cols], "distance": dist}
    for name in carry:
        side, index = (queries, rows) if name in queries.columns else (corpus, cols)
        part[name] = side[name].to_numpy()[index]
    return pd.DataFrame(part)[names]


class _Distinct:
    """The ``k`` nearest items of each query by id (the smaller one of equal distances), as lists of hits come in."""

    def __init__(self, queries: int, k: int) -> None:
        self.ids, self.dist = np.full((queries, k), -1, dtype=np.int64), np.full((queries, k), np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Hits of queries in ascending order."""
        known = ((self.ids[rows] == ids[:, None]) & (self.dist[rows] <= dist[:, None])).any(axis=1)
        rows, ids, dist = rows[~known], ids[~known], dist[~known]
        if not len(rows):
            return
        own, first, count = np.unique(rows, return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(own)), count), np.arange(len(rows)) - np.repeat(first, count)
        k, more = self.ids.shape[1], ((0, 0), (0, count.max()))
        all_ids = np.pad(self.ids[own], more, constant_values=-1)
        all_dist = np.pad(self.dist[own], more, constant_values=np.inf)
        all_ids[place[0], k + place[1]], all_dist[place[0], k + place[1]] = ids, dist
        order = np.lexsort((all_dist, all_ids))
        all_ids, all_dist = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_dist, order, 1)
        all_dist[:, 1:][all_ids[:, 1:] == all_ids[:, :-1]] = np.inf
        order = np.lexsort((all_ids, all_dist))[:, :k]
        self.ids[own], self.dist[own] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_dist, order, 1)


def _tile_shared(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, codes: str, most: int, tile: int) -> pd.DataFrame:
    """The best ``k`` of each query among the rows that share a bucket with it: each bucket of each table by itself."""
    if queries.empty or corpus.empty:
        return pd.DataFrame(columns=["query_id", "item_id", "distance"])
    q, c = np.stack(queries["query_vec"].to_numpy()), np.stack(corpus["item_vec"].to_numpy())
    of_query, of_item = (np.stack(side[codes].to_numpy()).astype(np.int64) for side in (queries, corpus))
    ids, ranks = np.unique(corpus["item_id"].to_numpy(), return_inverse=True)
    best = _Distinct(len(q), k)
    for table in range(of_item.shape[1]):
        order = np.argsort(of_item[:, table], kind="stable")
        buckets, first = np.unique(of_item[order, table], return_index=True)
        for bucket, cols in zip(buckets, np.split(order, first[1:])):
            rows = np.flatnonzero(np.bitwise_count(of_query[:, table] ^ bucket) <= most)
            nearest = _Nearest(q[rows], c[cols], ranks[cols], k, best.dist[rows, -1])
            nearest.compare(np.arange(len(rows)), 0, len(cols), tile)
            found, at, dist = nearest.top()
            best.add(rows[found], ranks[cols[at]], dist)
    rows, places = np.nonzero(np.isfinite(best.dist))
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[rows], "item_id": ids[best.ids[rows, places]], "distance": best.dist[rows, places]})


def _schema(queries: DataFrame, corpus: DataFrame, carry: Sequence[str]) -> StructType:
    schema = StructType().add("query_id", queries.schema["query_id"].dataType)
    schema = schema.add("item_id", corpus.schema["item_id"].dataType).add("distance", "double")
    for name in carry:
        source = queries if name in queries.columns else corpus
        schema = schema.add(name, source.schema[name].dataType)
    return schema


def _sizes(df: DataFrame, keys: Sequence[str], name: str, vec: str | None = None) -> DataFrame:
    width = [] if vec is None else [F.max(F.size(vec)).alias("__width")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), *width)


def tiled_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    keys: Sequence[str],
    carry: Sequence[str] = (),
    tile: int = TILE,
    collapse: bool = False,
    most: str | None = None,
    member: str | None = None,
    values: int = VALUES,
    codes: str | None = None,
    sides: int = 0,
) -> DataFrame:
    """Up to ``k`` nearest items per query *within each tile*; the k nearest overall are among them.

    ``queries`` is ``(keys..., query_id, query_vec)``, ``corpus`` is ``(keys..., item_id, item_vec)``. An item may have
    several rows; with ``collapse`` it counts once, at the distance of its nearest row. ``most`` is a column of the
    queries: the greatest distance of a hit, null for any. ``member`` is a number of the corpus rows and a list of such
    numbers in the queries: within its keys a query meets the rows whose number is in its list. ``codes`` is a list of
    numbers on both sides, one a hash table: rows meet if at one place their numbers differ in at most ``sides`` bits, and
    an item counts once.

    A block of a side has ``tile`` rows, or more as long as its vectors have at most ``values`` numbers: rows travel once
    for each block of the other side. Products are cut to ``tile`` rows of the corpus.
    """
    keys = list(keys)
    # Both sides may come from one table; fresh columns keep their keys apart.
    corpus = corpus.select(*[F.col(name).alias(name) for name in corpus.columns])

    def own_block(column: str, n: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(n)).cast("int")

    def all_blocks(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    cap = F.greatest(F.lit(tile), F.floor(F.lit(values) / F.greatest(F.coalesce("__width", F.lit(1)), F.lit(1))))

    def blocks(rows: str, of: Column | str) -> Column:
        return F.ceil(F.col(rows) / (F.col(of) if isinstance(of, str) else of)).cast("int")

    if keys:
        grid = _sizes(queries, keys, "__qr").join(_sizes(corpus, keys, "__cr", "item_vec"), keys, "inner").withColumn("__cap", cap)
        grid = grid.select(*keys, (F.col("__qr") + F.col("__cr")).alias("__rows"), "__cap", blocks("__qr", "__cap").alias("__qn"), blocks("__cr", "__cap").alias("__cn"))
        # Groups of one block share tiles: as many as their rows fill, and a few for the cores of a small table. Larger
        # groups have tiles of their own.
        one = F.greatest("__qn", "__cn") == 1
        filled, spare = F.ceil(F.sum("__rows") / F.min("__cap")), F.ceil(F.sum("__rows") / F.lit(tile))
        tiles = grid.where(one).agg(F.greatest(filled, F.least(spare, F.lit(SPREAD**2))).alias("n")).scalar()
        spread = F.xxhash64(*keys)
        own = F.when(one, F.pmod(spread, F.greatest(tiles, F.lit(1)))).otherwise(-1 - F.shiftrightunsigned(spread, 1))
        grid = grid.withColumn("__pack", own).drop("__rows", "__cap")
        q, c = salted_join(queries, grid, keys, ["query_id"]), salted_join(corpus, grid, keys, ["item_id"])
    else:
        # One group: its two sizes are scalars, nothing is joined. A small table is cut for the cores as well.
        n = F.greatest(blocks("n", cap), F.least(blocks("n", F.lit(tile)), F.lit(SPREAD)))
        sizes = {"__qn": _sizes(queries, [], "n", "query_vec").select(n).scalar(), "__cn": _sizes(corpus, [], "n", "item_vec").select(n).scalar()}
        q, c = (df.withColumns({**sizes, "__pack": F.lit(0).cast("bigint")}) for df in (queries, corpus))
    q = q.withColumn("__qb", own_block("query_id", "__qn")).withColumn("__cb", all_blocks("__cn"))
    c = c.withColumn("__cb", own_block("item_id", "__cn")).withColumn("__qb", all_blocks("__qn"))
    q, c = q.drop("__qn", "__cn"), c.drop("__qn", "__cn").withColumn("__pack", F.col("__pack").alias("__pack"))
    cell = ["__pack", "__qb", "__cb"]
    names = list(carry)
    schema = _schema(queries, corpus, names)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if codes is not None:
            return _tile_shared(left, right, k, codes, sides, tile)
        return _tile_top(left, right, keys, k, names, collapse, most, member, tile)

    return q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInPandas(work, schema)


def rank_hits(hits: DataFrame, k: int, by: Sequence[str] = ("query_id",), order: Sequence[str] = ("distance", "item_id")) -> DataFrame:
    """The ``k`` best hits per query with their rank; each task keeps only its own best ``k`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def filter_corpus(
    corpus: DataFrame, typename: str | Sequence[str] | None = None, kind: str | None = None, product: str | None = None
) -> DataFrame:
    """Tag filters on ``typename``, ``op_types`` and ``products``."""
    if typename is not None:
        wanted = [typename] if isinstance(typename, str) else list(typename)
        corpus = corpus.where(F.col("typename").isin(wanted))
    if kind is not None:
        corpus = corpus.where(F.array_contains("op_types", kind))
    if product is not None:
        corpus = corpus.where(F.array_contains("products", product))
    return corpus


def restrict(corpus: DataFrame, hits: DataFrame, parent: str) -> DataFrame:
    """``(query_id, candidate)`` rows for candidates whose parent is among the hits of the previous level."""
    return hits.join(corpus, parent, "inner")


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    keys: Sequence[str] = (),
    tile: int = TILE,
) -> DataFrame:
    """``(query_id, item_id, distance, rank)``: the ``k`` items nearest to each query by cosine distance.

    ``queries`` holds ``query_id, query_vec`` and ``corpus`` holds ``item_id, item_vec``; with ``keys`` only rows that
    agree on them meet.
    """
    q = queries.select(*keys, "query_id", "query_vec")
    c = corpus.select(*keys, "item_id", "item_vec")
    return rank_hits(tiled_topk(q, c, k, keys, tile=tile), k)


FAR_SIDES = 0.36  # share of hyperplanes between a query and a far neighbour: an angle of 65 degrees
FOUND = 0.95


def _tables(bits: int, probes: int) -> int:
    """Tables that find a neighbour at ``FAR_SIDES`` with probability ``FOUND``, 8 at least."""
    one = sum(math.comb(bits, k) * FAR_SIDES**k * (1 - FAR_SIDES) ** (bits - k) for k in range(min(probes, bits) + 1))
    return max(8, math.ceil(math.log(1 - FOUND) / math.log(1 - one))) if one < 1 else 8


def knn_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    tables: int | None = None,
    bits: int | None = None,
    probes: int | None = None,
    seed: int = 17,
    tile: int = TILE,
) -> DataFrame:
    """Approximate neighbours: only rows that share a bucket meet, and those are ranked exactly.

    A bucket of a table is a pattern of ``bits`` sides of random hyperplanes. By default there are as many bits as make
    an average bucket one tile. A query also visits the buckets that differ in up to ``probes`` sides. By default a
    quarter of the bits may differ, and there are as many tables (8 at least) as find a neighbour at ``FAR_SIDES`` with
    a probability of ``FOUND``, so the recall does not fall as the bits grow (see ``recall``). A full bucket is tiled
    like any other group, so no candidate is cut.

    If a query visits as many buckets, over all tables, as a table has, a row travels once with its buckets of all tables
    for each block of the other side, and buckets meet within the tile; otherwise it travels to each bucket.
    """
    if bits is None:
        bits = max(1, math.ceil(math.log2(max(2, corpus.count()) / tile)))
    if probes is None:
        probes = max(1, bits // 4)
    if tables is None:
        tables = _tables(bits, probes)
    # A bucket length above the norm of a unit vector leaves two buckets per projection: its sign.
    lsh = BucketedRandomProjectionLSH(
        inputCol="__unit", outputCol="__hash", numHashTables=tables * bits, bucketLength=2.0, seed=seed
    )

    def with_unit(df: DataFrame, column: str) -> DataFrame:
        dense = df.withColumn("__raw", array_to_vector(F.col(column).cast("array<double>")))
        return Normalizer(inputCol="__raw", outputCol="__unit").transform(dense).drop("__raw")

    left, right = with_unit(queries, "query_vec"), with_unit(corpus, "item_vec")
    model = lsh.fit(right)
    sides = F.transform("__hash", lambda h: F.when(F.get(vector_to_array(h), F.lit(0)) < 0, F.lit(0)).otherwise(F.lit(1)))
    flips = [sum(1 << i for i in c) for n in range(min(probes, bits) + 1) for c in combinations(range(bits), n)]

    def pattern(row: Column) -> Column:
        return F.aggregate(row, F.lit(0).cast("bigint"), lambda code, side: code * 2 + side)

    def coded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        # Not a lambda over the tables: the optimiser would hash the row anew for each of them.
        own = [pattern(F.slice("__sides", t * bits + 1, bits)) for t in range(tables)]
        return model.transform(df).withColumn("__sides", sides).select(*columns, F.array(*own).alias("codes"))

    def bucketed(df: DataFrame, columns: Sequence[str], patterns: Sequence[int]) -> DataFrame:
        rows = df.select(*columns, F.posexplode("codes").alias("table", "code"))
        every = F.transform(F.array(*[F.lit(f).cast("bigint") for f in patterns]), lambda flip: F.col("code").bitwiseXOR(flip))
        return rows.select(*columns, "table", F.explode(every).alias("bucket"))

    q, c = coded(left, ["query_id", "query_vec"]), coded(right, ["item_id", "item_vec"])
    if tables * len(flips) >= 1 << bits:
        hits = tiled_topk(q, c, k, [], tile=tile, codes="codes", sides=min(probes, bits))
    else:
        q, c = bucketed(q, ["query_id", "query_vec"], flips), bucketed(c, ["item_id", "item_vec"], [0])
        hits = tiled_topk(q, c, k, ["table", "bucket"], tile=tile)
    return rank_hits(hits.groupBy("query_id", "item_id").agg(F.min("distance").alias("distance")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that an approximate search found."""
    both = exact.select("query_id", "item_id").join(
        found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left"
    )
    return both.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
