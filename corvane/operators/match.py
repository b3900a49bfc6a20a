"""Hierarchical match of whole request tables: applications, then their objects, then their operations.

A level ranks description rows by cosine distance among the children of the hits above, keeps the first row of each
element and adds its weighted distance to the score of its parent. Scores are distances: smaller is better.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.knn import rank_hits, tiled_topk
from corvane.operators.skew import cut_lineage, first_row
from corvane.vocab import (
    ANY_KIND,
    MATCH_TOP,
    TAG_APP,
    TAG_OBJECT,
    TAG_OPERATION,
    WEIGHT_APP,
    WEIGHT_OBJECT,
    WEIGHT_OPERATION,
)


def rewrite_requests(requests: DataFrame) -> DataFrame:
    """Fixed rules: a trigger called new is CREATED, and a slash command of slack is a message."""
    op = F.when(
        (F.col("kind") == "triggers") & ((F.col("op") == "new") | F.col("op").startswith("new ")), F.lit("CREATED")
    ).otherwise(F.col("op"))
    obj = F.when((F.col("app") == "slack") & (F.col("object") == "slash command"), F.lit("message")).otherwise(
        F.col("object")
    )
    return requests.withColumns({"op": op, "object": obj})


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Closest row of each element."""
    return first_row(hits.drop("item_id", "rank"), ["query_id", "element_id"], [F.col("distance")])


def _rows(vectors: DataFrame, keys: list[str], dedupe_first: bool) -> DataFrame:
    row = "element_id" if dedupe_first else "vec_id"
    return vectors.select(*keys, F.col(row).alias("item_id"), F.col("embedding").alias("item_vec"), "element_id")


def _level(
    asked: DataFrame, vectors: DataFrame, keys: list[str], k: int, weight: float, dedupe_first: bool, most: str | None = None
) -> DataFrame:
    """Hits ``(query_id, element_id, score, owner, grand_owner)`` of one level.

    ``asked`` is ``(keys..., query_id, query_vec, above, owner, grand_owner)``: what the hits inherit travels with the
    request. The cut to ``k`` counts description rows, so that fewer than ``k`` elements may remain; with
    ``dedupe_first`` it counts elements.
    """
    c = _rows(vectors, keys, dedupe_first)
    carry = ["element_id", "above", "owner", "grand_owner"]
    hits = dedupe_hits(rank_hits(tiled_topk(asked, c, k, keys, carry, collapse=dedupe_first, most=most), k))
    score = F.col("above") + F.lit(weight) * F.greatest("distance", F.lit(0.0))
    return hits.select("query_id", "element_id", score.alias("score"), "owner", "grand_owner")


def match_apps(requests: DataFrame, vectors: DataFrame, n: int = MATCH_TOP, dedupe_first: bool = False) -> DataFrame:
    """Application hits ``(query_id, element_id, score, ...)``."""
    asked = requests.select(
        F.col("request_id").alias("query_id"),
        F.col("app_vec").alias("query_vec"),
        F.lit(0.0).alias("above"),
        F.lit(-1).cast("bigint").alias("owner"),
        F.lit(-1).cast("bigint").alias("grand_owner"),
    )
    apps = vectors.where(F.col("typename") == TAG_APP)
    return _level(asked, apps, [], n, WEIGHT_APP, dedupe_first)


def _children(
    requests: DataFrame, parents: DataFrame, vectors: DataFrame, vec: str, tag: str, k: int, weight: float, dedupe_first: bool, probe: int = 0
) -> DataFrame:
    """Hits among the children of ``parents``; with ``probe`` a first round over so many children of each parent bounds them."""
    above = parents.select("query_id", F.col("element_id").alias("parent_key"), F.col("score").alias("above"), F.col("owner").alias("grand_owner"))
    vecs = requests.select(
        F.col("request_id").alias("query_id"),
        F.col(vec).alias("query_vec"),
        F.coalesce("kind", F.lit(ANY_KIND)).alias("kind_key"),
    )
    # A candidate is listed under each of its kinds and under "any", so that the kind filter is part of the join key.
    own = F.coalesce("op_types", F.array().cast("array<string>"))
    kinds = F.explode(F.array_distinct(F.concat(own, F.array(F.lit(ANY_KIND)))))
    candidates = vectors.where(F.col("typename") == tag).withColumns({"parent_key": F.col("parent_id"), "kind_key": kinds})
    keys = ["parent_key", "kind_key"]
    most = None
    if probe:
        # The k-th of the nearest few of all parents is no nearer than the k-th of all, so what is farther stays in its
        # tile: about 2 k rows leave the tiles for a request, not k for each parent.
        near = rank_hits(tiled_topk(vecs.join(above, "query_id"), _rows(candidates, keys, dedupe_first), probe, keys, collapse=dedupe_first), k)
        most = "most"
        above = above.join(cut_lineage(near.where(F.col("rank") == k).select("query_id", F.col("distance").alias(most))), "query_id", "left")
    asked = vecs.join(above, "query_id", "inner").withColumn("owner", F.col("parent_key"))
    return _level(asked, candidates, keys, k, weight, dedupe_first, most)


def match_objects(
    requests: DataFrame, app_hits: DataFrame, vectors: DataFrame, n: int = MATCH_TOP, dedupe_first: bool = False
) -> DataFrame:
    """Object hits under the matched applications (``owner``)."""
    return _children(requests, app_hits, vectors, "object_vec", TAG_OBJECT, n * n, WEIGHT_OBJECT, dedupe_first)


def match_ops(
    requests: DataFrame, object_hits: DataFrame, vectors: DataFrame, n: int = MATCH_TOP, dedupe_first: bool = False
) -> DataFrame:
    """Operation hits under the matched objects (``owner``) of applications (``grand_owner``)."""
    return _children(requests, object_hits, vectors, "op_vec", TAG_OPERATION, 4 * n * n, WEIGHT_OPERATION, dedupe_first, probe=4)


def match_records(
    requests: DataFrame,
    vectors: DataFrame,
    elements: DataFrame | None = None,
    n: int = MATCH_TOP,
    product: str | None = None,
    dedupe_first: bool = False,
) -> DataFrame:
    """Best ``n`` operations per request with the ids of object and application, and the names if elements are given.

    ``requests`` is ``(request_id, app_vec, object_vec, op_vec, kind)``, ``vectors`` is ``(vec_id, element_id,
    parent_id, typename, op_types, products, embedding)``, one row per description of an element.
    """
    if product is not None:
        vectors = vectors.where(F.array_contains("products", product))
    # Hits are n (and n * n) short rows per request; each level is needed by the sizes and by the tiles of the next.
    app_hits = cut_lineage(match_apps(requests, vectors, n, dedupe_first))
    object_hits = cut_lineage(match_objects(requests, app_hits, vectors, n, dedupe_first))
    op_hits = match_ops(requests, object_hits, vectors, n, dedupe_first)
    rows = rank_hits(op_hits, n, order=("score", "element_id")).select(
        F.col("query_id").alias("request_id"),
        "rank",
        F.col("grand_owner").alias("app_id"),
        F.col("owner").alias("object_id"),
        F.col("element_id").alias("op_id"),
        "score",
    )
    if elements is None:
        return rows
    for level in ("app", "object", "op"):
        named = elements.select(F.col("element_id").alias(f"{level}_id"), F.col("full_name").alias(level))
        rows = rows.join(named, f"{level}_id", "left")
    kinds = elements.select(F.col("element_id").alias("op_id"), F.get("op_types", F.lit(0)).alias("kind"))
    return rows.join(kinds, "op_id", "left")
