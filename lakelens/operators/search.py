"""Search postings over named objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.scalars import token_norm, tokens


def postings(rows: DataFrame, key: str, weights: dict[str, float], kind: str) -> DataFrame:
    """(token, token_norm, doc_type, doc_id, field, score): a row for every occurrence of a
    word in each weighted field; repeated words give repeated rows."""
    parts = []
    for name, weight in weights.items():
        each = rows.select(F.col(key).cast("string").alias("doc_id"), F.explode(tokens(name)).alias("token"))
        parts.append(
            each.select(
                "token",
                token_norm("token").alias("token_norm"),
                F.lit(kind).alias("doc_type"),
                "doc_id",
                F.lit(name).alias("field"),
                F.lit(weight).cast("float").alias("score"),
            )
        )
    return reduce(DataFrame.union, parts)


def catalog_postings(namespaces: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Postings of all catalog objects: names weigh 1.0, descriptions 0.5."""
    weights = {"name": 1.0, "description": 0.5}
    kinds = (("namespace", namespaces), ("table", tables), ("column", columns))
    return reduce(DataFrame.union, (postings(rows, "id", weights, kind) for kind, rows in kinds))


def search(found: DataFrame, words: list[str], limit: int = 100) -> DataFrame:
    """(doc_type, doc_id, score) of objects with any of the words, best first."""
    hit = found.where(F.col("token_norm").isin(*(w.lower() for w in words)))
    total = hit.groupBy("doc_type", "doc_id").agg(F.sum("score").alias("score"))
    return total.orderBy(F.desc("score"), "doc_type", "doc_id").limit(limit)
