"""Approximate (or exact) nearest neighbours by a cell index.

Directions are cut into cells around centroids, which are fitted on a sample of bounded size; every row is listed in the
cell of its nearest centroid, and a cell knows the least and the greatest angle of its rows. A search has two rounds. The
first ranks the rows of each query's nearest cells; the k-th of them is a floor. The second visits those other cells
that can still hold a better row:

* with ``exact`` by the triangle inequality of angles, so that the result is that of the exact search;
* else by the same bound for a row that leaves its centroid in a direction of its own: the part of it along the query is
  then no more than ``deviations`` standard deviations of a random direction. By default these grow with the root of the
  logarithm of the number of rows, as the largest of so many draws does, so recall does not fall as the corpus grows.

Rows lie in one cell, so no pair is compared twice. Cells are packed up to the size of a block, and a query's vector
travels once for each pack that it visits a cell of, with the list of these cells. A cell of any size is tiled like any
other group. Vectors without any structure cannot be pruned: there nearly all cells
are visited. Clustered vectors leave one or two in a hundred rows to compare.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corvane.functions.vectors import unit_rows
from corvane.operators.knn import SPREAD, TILE, VALUES, rank_hits, tiled_topk
from corvane.operators.skew import cut_lineage

SAMPLE_ROWS = 16_384  # rows that the centroids are fitted on, at most
MOST_CELLS = 4_096
ROUNDS = 8
FIRST = 4  # the first round reads cells until they hold so many times k rows
SHARE_OF_EXTREME = 0.7
SLACK = 1e-7
_BLOCK = 1 << 20  # cosines of rows and centroids that are held at a time


@dataclass(frozen=True)
class CellIndex:
    """``rows`` (item_id, item_vec, cell, pack), and of each cell its centroid, row count, greatest and least cosine, and
    pack."""

    rows: DataFrame
    centroids: np.ndarray
    counts: np.ndarray
    near: np.ndarray
    far: np.ndarray
    packs: np.ndarray


def _parts(rows: int, cells: int) -> list[slice]:
    """Parts of the rows whose cosines with all cells fit a block."""
    step = max(1, _BLOCK // max(1, cells))
    return [slice(start, start + step) for start in range(0, rows, step)]


def pack_cells(counts: np.ndarray, rows: int) -> np.ndarray:
    """Number of each cell's pack: cells in a row that begin within the same ``rows`` rows."""
    return ((np.cumsum(counts) - counts) // rows).astype(np.int32)


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from the first rows of the sample; a centroid that loses all rows stays where it is."""
    centroids = sample[:cells].copy()
    for _ in range(ROUNDS if len(centroids) else 0):
        nearest = np.concatenate([(sample[p] @ centroids.T).argmax(axis=1) for p in _parts(len(sample), len(centroids))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids[moved] = unit_rows(sums[moved])
    return centroids


def build_cells(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE_ROWS) -> CellIndex:
    """Index of ``(item_id, item_vec)``. By default as many cells as the root of the number of rows, within MOST_CELLS."""
    corpus = corpus.select("item_id", "item_vec").where("item_vec IS NOT NULL")
    total = corpus.count()
    wanted = min(cells or math.ceil(math.sqrt(total)), MOST_CELLS, sample)
    # A sample by hash: the same rows whatever the partitioning, and at most ``sample`` of them on the driver.
    picked = corpus.orderBy(F.xxhash64("item_id"), "item_id").limit(sample).select("item_vec").toArrow()
    vectors = unit_rows(np.stack(picked.column(0).to_pylist())) if picked.num_rows else np.zeros((0, 1))
    vectors = np.unique(vectors, axis=0)[np.random.default_rng(0).permutation(len(np.unique(vectors, axis=0)))]
    centroids = fit_centroids(vectors, min(wanted, len(vectors)))
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, cosine double")
    def place(values: pd.Series) -> pd.DataFrame:
        rows = unit_rows(np.stack(values.to_numpy()))
        each = (rows[p] @ shared.value.T for p in _parts(len(rows), len(shared.value)))
        best = [(found.argmax(axis=1).astype(np.int32), found.max(axis=1)) for found in each]
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("cell", "cosine"), zip(*best))})

    placed = cut_lineage(corpus.withColumn("p", place("item_vec")).select("item_id", "item_vec", "p.cell", "p.cosine"))
    counts, near, far = np.zeros(len(centroids), np.int64), np.ones(len(centroids)), np.ones(len(centroids))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("near"), F.min("cosine").alias("far"))
    for r in stats.collect():  # at most MOST_CELLS rows
        counts[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["near"], r["far"]
    # Packs of a block, or of fewer rows for the cores of a small table.
    packs = pack_cells(counts, max(TILE, min(VALUES // max(1, centroids.shape[1]), math.ceil(total / SPREAD))))
    of_cell = F.element_at(F.lit(packs.tolist() or [0]), F.col("cell") + 1).cast("int")
    return CellIndex(placed.drop("cosine").withColumn("pack", of_cell), centroids, counts, near, far, packs)


def first_cells(cosines: np.ndarray, counts: np.ndarray, rows: int) -> list[np.ndarray]:
    """Of each query the nearest cells that together hold ``rows`` rows."""
    order = np.argsort(-cosines, axis=1, kind="stable")
    enough = np.cumsum(counts[order], axis=1) - counts[order] < rows
    return [o[e & (counts[o] > 0)] for o, e in zip(order, enough)]


def best_cosine(cosines: np.ndarray, near: np.ndarray, far: np.ndarray, along: float) -> np.ndarray:
    """The greatest cosine that a row of each cell may have with each query.

    A row at the angle r from a centroid that is at the angle a has the cosine cos a cos r + sin a sin r u, where u is at
    most ``along`` (1: the triangle inequality). Over the angles r of a cell that is a hill with one top.
    """
    cos_a = np.clip(cosines, -1, 1)
    sin_a = np.sqrt(1 - cos_a**2)
    top = np.arctan2(sin_a * along, cos_a)
    r = np.clip(top, np.arccos(np.clip(near, -1, 1)), np.arccos(np.clip(far, -1, 1)))
    return cos_a * np.cos(r) + sin_a * np.sin(r) * along


def _visits(queries: DataFrame, packs: np.ndarray, choose) -> DataFrame:
    """``(query_id, query_vec, floor, pack, cells)``: the cells that ``choose`` names for each row of a frame of queries,
    a row for each of their packs."""

    def run(frames):
        for frame in frames:
            for part in _parts(len(frame), len(packs)):
                some = frame.iloc[part]
                lists = [x.astype(np.int32) for x in choose(some)]
                # Cells come in order, so those of a pack are next to each other.
                own = [np.unique(packs[x], return_index=True) for x in map(np.sort, lists)]
                cells = [np.split(np.sort(x), starts[1:]) if len(x) else [] for x, (_, starts) in zip(lists, own)]
                out = some[["query_id", "query_vec", "floor"]].assign(pack=[x for x, _ in own], cells=cells)
                yield out.explode(["pack", "cells"]).dropna(subset=["pack"]).astype({"pack": np.int32})

    schema = queries.select("query_id", "query_vec", "floor").schema.add("pack", IntegerType()).add("cells", ArrayType(IntegerType()))
    return queries.select("query_id", "query_vec", "floor").mapInPandas(run, schema)


def _rounds(index: CellIndex, queries: DataFrame, k: int, exact: bool, deviations: float | None, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visits and hits of the first round, and the visits of the second one."""
    queries = queries.select("query_id", "query_vec").where("query_vec IS NOT NULL")
    total, width = int(index.counts.sum()), index.centroids.shape[1]
    if deviations is None:
        deviations = SHARE_OF_EXTREME * math.sqrt(2 * math.log(max(2, total)))
    along = 1.0 if exact or width < 3 else min(1.0, deviations / math.sqrt(width - 1))
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.counts, index.near, index.far))

    def cosines(frame: pd.DataFrame) -> np.ndarray:
        centroids = shared.value[0]
        return unit_rows(np.stack(frame["query_vec"].to_numpy())) @ centroids.T if len(centroids) else np.zeros((len(frame), 0))

    def nearest(frame: pd.DataFrame) -> list[np.ndarray]:
        return first_cells(cosines(frame), shared.value[1], FIRST * k)

    def remaining(frame: pd.DataFrame) -> list[np.ndarray]:
        _, counts, near, far = shared.value
        found = cosines(frame)
        floor = 1.0 - frame["floor"].fillna(3.0).to_numpy() - SLACK
        may = (best_cosine(found, near, far, along) >= floor[:, None]) & (counts > 0)
        return [np.setdiff1d(np.flatnonzero(m), seen) for m, seen in zip(may, first_cells(found, counts, FIRST * k))]

    first = _visits(queries.withColumn("floor", F.lit(None).cast("double")), index.packs, nearest)
    hits = cut_lineage(rank_hits(_search(index, first, k, tile), k))
    floors = hits.where(F.col("rank") == k).select("query_id", F.col("distance").alias("floor"))
    return first, hits, _visits(queries.join(floors, "query_id", "left"), index.packs, remaining)


def _search(index: CellIndex, visits: DataFrame, k: int, tile: int) -> DataFrame:
    asked = visits.withColumnRenamed("cells", "cell")
    return tiled_topk(asked, index.rows, k, ["pack"], tile=tile, most="floor", member="cell")


def search_cells(
    index: CellIndex, queries: DataFrame, k: int, exact: bool = False, deviations: float | None = None, tile: int = TILE
) -> DataFrame:
    """``(query_id, item_id, distance, rank)``: the ``k`` nearest items of each query among the cells that it visits.

    A query without a vector has no hits, and neither has any query of an empty index. ``query_id`` is one row a query.
    """
    _, hits, others = _rounds(index, queries, k, exact, deviations, tile)
    more = _search(index, others, k, tile)
    return rank_hits(hits.drop("rank").unionByName(more), k)


def compared_pairs(index: CellIndex, visits: DataFrame) -> int:
    """Pairs of a query and a row that the visited cells make, from the numbers of visits of each cell."""
    rows = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MOST_CELLS rows
    return sum(int(index.counts[r["cell"]]) * r["n"] for r in rows)
