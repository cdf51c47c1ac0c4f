"""Ordering operators: fair selection, chunks, pages, keep-last and prefix counts."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fair_order(tasks: DataFrame, tenant: str, weight: str, within: Sequence[str]) -> DataFrame:
    """Deficit round robin in closed form, as ``fair_rank`` from 1.

    The k-th task of a tenant with weight w runs in round k div w; in a round the tenant
    with most credit left goes first, ties by tenant.  ``within`` orders a tenant's tasks.
    """
    k = F.row_number().over(Window.partitionBy(tenant).orderBy(*within)) - 1
    w = F.greatest(F.col(weight), F.lit(1))
    rows = tasks.withColumn("_k", k).withColumn("_round", F.floor(F.col("_k") / w)).withColumn("_level", w - F.col("_k") % w)
    order = Window.orderBy("_round", F.desc("_level"), tenant)
    return rows.withColumn("fair_rank", F.row_number().over(order)).drop("_k", "_round", "_level")


def fair_select(tasks: DataFrame, tenant: str, weight: str, within: Sequence[str], slots: int) -> DataFrame:
    """The first ``slots`` tasks in fair order: each tenant offers at most that many, so the
    global sort sees tenants * slots rows."""
    per = Window.partitionBy(tenant).orderBy(*within)
    few = tasks.withColumn("_n", F.row_number().over(per)).where(F.col("_n") <= slots).drop("_n")
    return fair_order(few, tenant, weight, within).where(F.col("fair_rank") <= slots)


def keep_last(rows: DataFrame, by: Sequence[str], version: str, keep: int) -> DataFrame:
    """Rows beyond the ``keep`` newest versions of each group: what may be collected."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(version)))
    return rows.withColumn("_n", n).where(F.col("_n") > keep).drop("_n")


def chunks(keys: DataFrame, key: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Ordered keys cut into lists of ``size``: (by…, chunk_index, keys)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1
    rows = keys.withColumn("chunk_index", F.floor(n / size).cast("int"))
    return rows.groupBy(*by, "chunk_index").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def earliest(rows: DataFrame, by: str, at: str, most: str) -> DataFrame:
    """The first ``most`` (a column) rows of each group."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(at))
    return rows.withColumn("_n", n).where(F.col("_n") <= F.col(most)).drop("_n")


def contiguous_prefix(rows: DataFrame, by: str, index: str) -> DataFrame:
    """(by, prefix): how many indexes are there from 0 on without a gap."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(index)) - 1
    one = rows.select(by, index).distinct().withColumn("_n", n)
    return one.groupBy(by).agg(F.count_if(F.col(index) == F.col("_n")).alias("prefix"))


def budget_page(rows: DataFrame, order: str, size: str, budget: int, limit: int = 50) -> DataFrame:
    """Rows in order until their sizes pass the budget; a first row beyond it is an error,
    shown as ``too_large``."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    page = rows.orderBy(order).limit(limit)
    page = page.withColumn("_sum", F.sum(size).over(w)).withColumn("_n", F.row_number().over(Window.orderBy(order)))
    fit = page.where((F.col("_sum") <= budget) | (F.col("_n") == 1))
    return fit.withColumn("too_large", F.col(size) > budget).drop("_sum", "_n")


# -- keyset pages --------------------------------------------------------------

Key = tuple[str, bool]  # column, ascending


def after_cursor(keys: Sequence[Key], values: Sequence[Any]) -> Column:
    """Rows strictly after ``values`` in the order of ``keys``, as an or-chain that filters
    can push down."""
    out = F.lit(False)
    same = F.lit(True)
    for (name, ascending), value in zip(keys, values):
        c = F.col(name)
        out = out | (same & (c > F.lit(value) if ascending else c < F.lit(value)))
        same = same & (c == F.lit(value))
    return out


def keyset_page(rows: DataFrame, keys: Sequence[Key], after: Sequence[Any] | None, limit: int) -> DataFrame:
    """``limit + 1`` rows after the cursor: the last only tells that there are more."""
    if after is not None:
        rows = rows.where(after_cursor(keys, after))
    return rows.orderBy(*(F.col(k).asc() if up else F.col(k).desc() for k, up in keys)).limit(limit + 1)


def cursor(values: Sequence[Any]) -> str:
    """Opaque text of a page's last key; numbers are padded so that texts sort like them."""
    text = [f"{v:020d}" if isinstance(v, int) and not isinstance(v, bool) else v for v in values]
    return base64.urlsafe_b64encode(json.dumps(text).encode()).decode().rstrip("=")


def read_cursor(text: str, kinds: Sequence[type]) -> list[Any] | int:
    """The key in a cursor; an all-digit text is a legacy offset."""
    if text.isdigit():
        return int(text)
    try:
        values = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if not isinstance(values, list) or len(values) != len(kinds):
            raise ValueError
        return [kind(v) for v, kind in zip(values, kinds)]
    except (ValueError, TypeError) as e:
        raise ValueError("malformed cursor") from e


def page_size(asked: int | None, default: int, most: int) -> int:
    """0 and None mean the default; more than the most is an error."""
    if not asked:
        return default
    if asked < 0 or asked > most:
        raise ValueError(f"limit must be between 1 and {most}")
    return asked
