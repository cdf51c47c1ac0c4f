"""The table catalog and what queries may see of it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators.joins import read_model
from lakelens.plans.sqlgate import MAX_TABLE_BYTES, QueryError, Snapshot, TooLarge, UserData
from lakelens.sources import schemas
from lakelens.sources.snapshots import Files

#: Snapshot tables the metadata surface knows by two-part names.
SNAPSHOT_TABLES = ("catalog.catalogs", "catalog.namespaces", "catalog.tables", "catalog.columns", "lineage.edges")


def system_view(df: DataFrame, name: str, tenant: str | None = None, workspace: str | None = None) -> DataFrame:
    """What ``system.<name>`` shows: exact-schema tables are checked, hidden columns are gone
    before a query can name them, and the run index is cut to the caller's workspace."""
    if name in schemas.INTERNAL:
        raise QueryError(f"table not found: system.{name}")
    if name in schemas.EXACT:
        schemas.require_exact(df, name)
    view = schemas.safe_projection(df, name)
    if name == "orchestration.catalog_run_index":
        if tenant is None or workspace is None:
            raise QueryError("the run index needs a tenant and a workspace")
        view = view.where((F.col("org_id") == tenant) & (F.col("workspace_id") == workspace))
    return view


def metadata_surface(tables: dict[str, DataFrame], tenant: str, workspace: str) -> Snapshot:
    """The query surface over metadata tables given by schema name.  Views are lazy: only
    what a query names is read."""
    known: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if name in SNAPSHOT_TABLES:
            known["lineage.lineage_edges" if name == "lineage.edges" else name] = df
        if name not in schemas.INTERNAL:
            known[f"system.{name}"] = system_view(df, name, tenant, workspace)
    return Snapshot(known, frozenset(SNAPSHOT_TABLES) | {"lineage.lineage_edges"})


@dataclass
class Catalog:
    """Resolves catalog.schema.table to data below a root.  ``model`` is the read model."""

    spark: SparkSession
    root: str
    model: DataFrame
    tenant: str = ""
    workspace: str = ""

    @staticmethod
    def of(spark: SparkSession, root: str, catalogs: DataFrame, namespaces: DataFrame, tables: DataFrame, columns: DataFrame, tenant: str = "", workspace: str = "") -> Catalog:
        return Catalog(spark, root, read_model(catalogs, namespaces, tables, columns), tenant, workspace)

    def locate(self, catalog: str, schema: str, table: str) -> str | None:
        """The table's path below the root; None if the catalog has no such table."""
        rows = self.model.where((F.col("catalog_name") == catalog) & (F.col("namespace_name") == schema) & (F.col("table_name") == table))
        row = rows.select("location", F.coalesce(F.lower(F.trim("format")), F.lit("parquet")).alias("format")).first()
        if row is None:
            return None
        if row.format != "parquet":
            raise QueryError(f"tables of format {row.format} cannot be queried")
        return self.scoped(row.location or "")

    def scoped(self, location: str) -> str:
        """A location relative to the workspace; anything outside is refused."""
        path = location.lstrip("/")
        prefix = f"tenant={self.tenant}/workspace={self.workspace}/"
        if "://" in path or re.search(r"(^|/)\.\.?(/|$)", path) or not path:
            raise QueryError("the table's location is not inside the workspace")
        if path.startswith("tenant="):
            if not path.startswith(prefix):
                raise QueryError("the table belongs to another workspace")
            path = path[len(prefix) :]
        if not path.endswith(".parquet"):
            raise QueryError("the table is not a Parquet file")
        return path

    def resolve(self, catalog: str, schema: str, table: str) -> tuple[DataFrame, int] | None:
        path = self.locate(catalog, schema, table)
        if path is None:
            return None
        size = Files(self.spark, self.root).size(path)
        if size > MAX_TABLE_BYTES:
            raise TooLarge(f"{table} is too large")
        return self.spark.read.parquet(f"{self.root}/{path}"), size

    def surface(self) -> UserData:
        return UserData(self.resolve)


def mintable(paths: DataFrame, allowed: DataFrame) -> DataFrame:
    """Paths external readers may get: those the manifest selects."""
    return paths.join(allowed.select("path").distinct(), "path", "left_semi")
