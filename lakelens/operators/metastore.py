"""Folds of catalog changes and of metastore records."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FoldError(ValueError):
    pass


class CatalogState:
    """Catalogs, namespaces, tables and columns under ordered changes.

    Changes are errors where they make no sense, so their fold is a strict sequence over
    what is a bounded catalog, not an aggregate: an identical re-create says nothing new,
    the same id with other content fails; names are unique under their parent; updates
    keep identities; what is deleted already is gone, what still has children stays;
    a dropped table takes its columns along.  Events up to the watermark are skipped."""

    PARENT = {"catalog": None, "namespace": ("catalog", "catalog_id"), "table": ("namespace", "namespace_id"), "column": ("table", "table_id")}
    IDENTITY = ("id", "catalog_id", "namespace_id", "table_id", "created_at")

    def __init__(self, watermark: str | None = None):
        self.watermark = watermark
        self.rows: dict[str, dict[str, dict[str, Any]]] = {k: {} for k in self.PARENT}
        self.edges: dict[str, dict[str, Any]] = {}

    def apply(self, event_id: str, kind: str, row: dict[str, Any]) -> None:
        """``kind`` is ``<object>.<created|updated|deleted|renamed>`` or ``edge.created``."""
        if self.watermark is not None and event_id <= self.watermark:
            return
        what, _, change = kind.partition(".")
        if what == "edge":
            self.edges.setdefault(row["id"], row)
        elif what not in self.rows or change not in ("created", "updated", "deleted", "renamed"):
            raise FoldError(f"unknown change {kind}")
        else:
            getattr(self, f"_{change}")(what, row)
        self.watermark = event_id

    def _parent(self, what: str, row: dict) -> Any:
        link = self.PARENT[what]
        if link is None:
            return None
        if what == "namespace" and row.get("catalog_id") is None:
            return next((c["id"] for c in self.rows["catalog"].values() if c["name"] == "default"), None)
        return row.get(link[1])

    def _unique(self, what: str, row: dict) -> None:
        for other in self.rows[what].values():
            if other["id"] != row["id"] and other["name"] == row["name"] and self._parent(what, other) == self._parent(what, row):
                raise FoldError(f"{what} {row['name']} exists")

    def _created(self, what: str, row: dict) -> None:
        before = self.rows[what].get(row["id"])
        if before is not None:
            if before != row:
                raise FoldError(f"{what} {row['id']} exists with other content")
            return
        link = self.PARENT[what]
        parent = self._parent(what, row)
        if link is not None and parent is not None and parent not in self.rows[link[0]]:
            raise FoldError(f"{link[0]} {parent} does not exist")
        self._unique(what, row)
        self.rows[what][row["id"]] = dict(row)

    def _updated(self, what: str, row: dict) -> None:
        before = self.rows[what].get(row["id"])
        if before is None:
            raise FoldError(f"{what} {row['id']} does not exist")
        if any(k in row and row[k] != before.get(k) for k in self.IDENTITY):
            raise FoldError("an update cannot change an identity")
        new = before | row
        self._unique(what, new)
        self.rows[what][row["id"]] = new

    _renamed = _updated

    def _deleted(self, what: str, row: dict) -> None:
        if row["id"] not in self.rows[what]:
            return
        for child, link in self.PARENT.items():
            if link is None or link[0] != what:
                continue
            held = [c["id"] for c in self.rows[child].values() if self._parent(child, c) == row["id"]]
            if held and what != "table":
                raise FoldError(f"{what} {row['id']} is not empty")
            for i in held:
                del self.rows[child][i]
        del self.rows[what][row["id"]]


def fold_catalog(events: DataFrame, watermark: str | None = None) -> CatalogState:
    """Replay catalog changes (event_id, kind, payload JSON) in order of their ids, read
    partition by partition."""
    state = CatalogState(watermark)
    ordered = events.select("event_id", "kind", "payload").dropDuplicates(["event_id"]).orderBy("event_id")
    for r in ordered.toLocalIterator():
        state.apply(r.event_id, r.kind, json.loads(r.payload))
    return state


# -- metastore records ---------------------------------------------------------------

#: The kinds of metastore records, and the prefix of those that aren't
#: securables themselves.
RECORD_KINDS = ("securable", "principal", "grant", "credential", "external_location", "workspace_binding", "path_governance")
_PREFIXED = {"principal": "PRINCIPAL", "grant": "GRANT", "credential": "CREDENTIAL"}
SECRET_FIELDS = ("secret", "private_key", "access_key", "token")


def replay(records: DataFrame) -> DataFrame:
    """The last upsert of every object by (sequence, position), per kind; deletes remove."""
    rest = [c for c in records.columns if c not in ("kind", "object_id")]
    last = records.where(F.col("kind").isin(*RECORD_KINDS)).groupBy("kind", "object_id").agg(
        F.max_by(F.struct(*rest), F.struct("sequence", "position")).alias("r")
    )
    return last.select("kind", "object_id", "r.*").where("not deleted")


def object_names(state: DataFrame) -> DataFrame:
    """Names of active securables; old and inactive names are gone."""
    return state.where("kind = 'securable' and lifecycle_state = 'ACTIVE'").select("name", "object_id", "object_type")


def principal_names(records: DataFrame) -> DataFrame:
    """Every name a principal ever had: the latest holder of each."""
    rows = records.where("kind = 'principal' and name is not null")
    return rows.groupBy("name").agg(F.max_by("object_id", F.struct("sequence", "position")).alias("object_id"))


def safe_objects(state: DataFrame, watermark: str) -> DataFrame:
    """What may be shown of all records, sorted by type and id: public columns only."""
    parts = []
    for kind in RECORD_KINDS:
        rows = state.where(F.col("kind") == kind)
        kind_type = F.lit(_PREFIXED[kind]) if kind in _PREFIXED else F.coalesce("object_type", F.lit(kind.upper()))
        parts.append(
            rows.select(
                F.lit(1).alias("schema_version"),
                F.lit(watermark).alias("ledger_watermark"),
                "object_id",
                kind_type.alias("object_type"),
                "name",
                "owner",
                "lifecycle_state",
                "updated_at",
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy("object_type", "object_id")
