"""Exact vector search: a scan of scores, a bounded top-k, then the rows by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediashoal.functions.vectors import cosine_to
from mediashoal.operators.pivots import PivotIndex
from mediashoal.plans.filters import listed

K_DEFAULT, K_MOST = 50, 200


def top_k(vectors: DataFrame, query: list[float], k: int | None = None, ident: str = "media_item_id", vector: str = "vector") -> DataFrame:
    """``(ident, score)``, best first; ties by id. Rows of another size are skipped."""
    return best(scores(vectors, query, ident, vector), k, ident)


def scores(vectors: DataFrame, query: list[float], ident: str = "media_item_id", vector: str = "vector") -> DataFrame:
    return vectors.select(ident, cosine_to(F.col(vector), query).alias("score")).where("score is not null")


def best(scored: DataFrame, k: int | None = None, ident: str = "media_item_id") -> DataFrame:
    return scored.orderBy(F.col("score").desc(), ident).limit(_most(k))


def _most(k: int | None) -> int:
    return min(max(K_DEFAULT if k is None else k, 1), K_MOST)


def search_semantic(
    media: DataFrame, embeddings: DataFrame | None, query: list[float], k: int | None = None, model: str | None = None, pre_filter: DataFrame | None = None, index: PivotIndex | None = None
) -> DataFrame:
    """Media with scores, best first. Missing media are included, and without a model a
    media item may come once for each of its models. ``pre_filter``: ids to search in;
    ``index``: of the embeddings, to skip what can't be among the best.
    """
    scope = media.where(listed()).select(F.col("id").alias("media_item_id"))
    if pre_filter is not None:
        scope = scope.join(pre_filter.select(F.col("id").alias("media_item_id")), "media_item_id", "left_semi")
    if index is not None:
        known = F.col("media_item_id").isNotNull()
        return _ranked(media, index.top_k(query, _most(k), scope=scope, where=known if model is None else known & (F.col("model") == model)))
    rows = embeddings.where(F.col("media_item_id").isNotNull())
    if model is not None:
        rows = rows.where(F.col("model") == model)
    return _ranked(media, best(scores(rows, query).join(scope, "media_item_id", "left_semi"), k))  # scored first: vectors stay where they are


def _ranked(media: DataFrame, hits: DataFrame) -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "media_item_id")))  # at most K_MOST rows
    return media.join(F.broadcast(ranked), media["id"] == ranked["media_item_id"]).drop("media_item_id").orderBy("rank")


def search_semantic_text(media: DataFrame, embeddings: DataFrame, text: str, embed: Callable[[str], list[float]], model: str, k: int | None = None) -> DataFrame:
    """Embeds the query only if the model has any vector."""
    rows = embeddings.where((F.col("model") == model) & F.col("media_item_id").isNotNull())
    if rows.limit(1).isEmpty():
        return search_semantic(media, rows, [0.0], k, model).limit(0)
    return search_semantic(media, rows, embed(text), k, model)


def semantic_then_name(hits: DataFrame, query: str) -> DataFrame:
    """Hits whose name or path has the text, lower-cased and without wildcards."""
    q = query.strip().lower()
    return hits.where(F.lower("file_name").contains(q) | F.lower("path").contains(q)) if q else hits


def rank_all(vectors: DataFrame, query: list[float], ident: str = "id") -> DataFrame:
    """All scores, rounded to 6 places, best first."""
    return vectors.select(ident, F.round(cosine_to(F.col("vector"), query), 6).alias("score")).orderBy(F.col("score").desc(), ident)
