"""Read-only SQL over registered tables: parse, check, bind names, run guarded.

A statement is parsed by Catalyst without being run, so commands never execute.
The parsed tree is walked for relations, table functions and functions; only
queries over allowed names pass.  Every relation in the tree knows where it stands in
the text; just there a private temporary view is put in its place, and nowhere else:
literals, comments and other names stay as they are.  The views are dropped as soon as
the query is analysed.  So a third-party catalog is not needed, an unrelated missing
table breaks nothing and no view of the caller's is touched.
"""

from __future__ import annotations

import io
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from lakelens.operators.graph import cut


class QueryError(Exception):
    """A client's mistake (status 400) unless told otherwise."""

    status = 400


class NotFound(QueryError):
    status = 404


class TooLarge(QueryError):
    status = 413


class TimedOut(QueryError):
    status = 408


class InternalError(QueryError):
    status = 500


MAX_SQL_BYTES = 10_000
MAX_ROWS = 10_000
MAX_RESULT_BYTES = 10 << 20
TIMEOUT_S = 10.0
MAX_TABLES = 25
MAX_TABLE_BYTES = 64 << 20
MAX_TOTAL_BYTES = 256 << 20
READ_ONLY = "Only SELECT/CTE queries are supported"

#: Functions that reach outside the query.
FORBIDDEN_FUNCTIONS = {"java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files", "current_catalog", "current_database", "current_schema", "current_user", "user", "session_user", "spark_partition_id", "version", "assert_true", "raise_error"}


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _children(node) -> list:
    """Plans below a plan or expression, through subqueries and common table expressions."""
    out = _seq(node.children()) + [x for x in _seq(node.innerChildren()) if hasattr(x, "children")]
    for more in ("expressions", "plan"):  # of plans; of subqueries
        try:
            got = getattr(node, more)()
        except (Py4JError, TypeError):
            continue
        out += [got] if more == "plan" else _seq(got)
    return out


def _place(node) -> tuple[int, int]:
    """Where a node stands in the text."""
    at = node.origin()
    return at.startIndex().get(), at.stopIndex().get() + 1


@dataclass
class Parsed:
    """A checked statement: its relations in order of appearance, common table names out."""

    sql: str
    relations: list[tuple[str, ...]] = field(default_factory=list)
    functions: set[str] = field(default_factory=set)
    #: where relations stand: (start, end) to (name, where an alias would go or None)
    places: dict[tuple[int, int], tuple[tuple[str, ...], int | None]] = field(default_factory=dict)
    #: where qualified columns and stars stand: (start, end) to (parts, is a star)
    columns: dict[tuple[int, int], tuple[tuple[str, ...], bool]] = field(default_factory=dict)
    recursive: bool = False


def parse(spark: SparkSession, sql: str) -> Parsed:
    """Check that ``sql`` is one read-only query and list what it names."""
    text = sql.strip()
    if not text:
        raise QueryError("query must not be empty")
    if len(text.encode()) > MAX_SQL_BYTES:
        raise QueryError(f"query must be at most {MAX_SQL_BYTES} bytes")
    text = text.rstrip(";").strip() if text.count(";") == 1 and text.endswith(";") else text
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise QueryError(f"cannot parse query: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e
    out = Parsed(text)
    ctes: set[str] = set()
    jvm = spark._jvm
    commands = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    parsed = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    found: list[tuple[str, ...]] = []

    def walk(node, above: tuple[str, ...] = (), outer=None) -> None:
        kind = node.getClass().getSimpleName()
        if commands.isInstance(node) or parsed.isInstance(node) or kind in ("InsertIntoStatement", "CompoundBody", "UnresolvedTableOrView"):
            raise QueryError(READ_ONLY)
        if kind in ("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"):
            raise QueryError("names must be written out")
        if kind == "UnresolvedWith":
            out.recursive |= node.allowRecursion()
            for pair in _seq(node.cteRelations()):
                ctes.add(pair._1().lower())
                walk(pair._2())
        elif kind == "UnresolvedRelation":
            name, at = tuple(_seq(node.multipartIdentifier())), _place(node)
            found.append(name)
            sampled = above[-1:] == ("Sample",)
            alias = None if "SubqueryAlias" in above[-1 - sampled :] else (_place(outer) if sampled else at)[1]
            if text[: at[0]].rstrip().lower().endswith("table"):  # TABLE name
                alias = None
            out.places[at] = (name, alias)
        elif kind == "UnresolvedAttribute":
            out.columns[_place(node)] = (tuple(_seq(node.nameParts())), False)
        elif kind == "UnresolvedStar" and node.target().isDefined():
            out.columns[_place(node)] = (tuple(_seq(node.target().get())), True)
        elif kind == "UnresolvedTableValuedFunction":
            out.functions.add(".".join(_seq(node.name())).lower())
        elif kind == "UnresolvedFunction":
            out.functions.add(".".join(_seq(node.nameParts())).lower())
        for child in _children(node):
            walk(child, (*above[-1:], kind), node)

    walk(plan)
    inside = lambda r: len(r) == 1 and r[0].lower() in ctes
    out.relations = list(dict.fromkeys(r for r in found if not inside(r)))
    out.places = {at: x for at, x in out.places.items() if not inside(x[0])}
    bad = sorted(f for f in out.functions if f in FORBIDDEN_FUNCTIONS)
    if bad:
        raise QueryError(f"function not allowed: {bad[0]}")
    return out


Resolver = Callable[[tuple[str, ...]], DataFrame | None]


def _bind(spark: SparkSession, parsed: Parsed, tables: dict[tuple[str, ...], DataFrame]) -> DataFrame:
    """The query's DataFrame with each relation bound to a private view."""
    quoted = lambda x: f"`{x.replace('`', '``')}`"
    views = {name: f"gate_{uuid.uuid4().hex}" for name in tables}
    edits: list[tuple[int, int, str]] = []
    for (start, end), (name, alias) in parsed.places.items():
        edits.append((start, end, views[name]))
        if alias is not None:  # its last part stays its alias, so that qualified columns resolve
            edits.append((alias, alias, f" AS {quoted(name[-1])}"))
    for (start, end), (parts, star) in parsed.columns.items():
        for name in tables:
            short = len(parts) >= len(name) + (not star) and len(name) > 1
            if short and [x.lower() for x in parts[: len(name)]] == [x.lower() for x in name]:
                edits.append((start, end, ".".join(map(quoted, parts[len(name) - 1 :])) + ".*" * star))
                break
    sql = parsed.sql
    for start, end, text in sorted(edits, reverse=True):
        sql = sql[:start] + text + sql[end:]
    try:
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        return spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


@dataclass
class Snapshot:
    """The metadata query surface: two-part snapshot names and allowed system names.
    ``names`` are those the surface knows of, whether or not a snapshot has them yet."""

    tables: dict[str, DataFrame]  # "schema.table" or "system.schema.table", lower case
    names: frozenset[str] = frozenset()

    def bind(self, spark: SparkSession, sql: str) -> DataFrame:
        parsed = parse(spark, sql)
        known: dict[tuple[str, ...], DataFrame] = {}
        asked = [x for x in (".".join(n).lower() for n in parsed.relations) if x in self.tables or x in self.names]
        if asked and not any(x in self.tables for x in asked):
            raise NotFound("no snapshot tables available for query")
        for name in parsed.relations:
            df = self.tables.get(".".join(name).lower())
            if df is not None:
                known[name] = df
            elif name[0].lower() in ("parquet", "json", "csv", "orc", "text", "avro", "delta", "binaryfile"):
                raise QueryError("files cannot be queried directly")
            else:
                raise QueryError(f"table not found: {'.'.join(name)}")
        return _run(spark, parsed, known)


@dataclass
class UserData:
    """The data query surface: every relation is catalog.schema.table, case counts.
    ``resolve`` gives a table's DataFrame and size, or None."""

    resolve: Callable[[str, str, str], tuple[DataFrame, int] | None]

    def bind(self, spark: SparkSession, sql: str) -> DataFrame:
        parsed = parse(spark, sql)
        names = parsed.relations
        if any(len(n) != 3 for n in names):
            raise QueryError("tables must be named catalog.schema.table")
        if len(names) > MAX_TABLES:
            raise QueryError(f"a query may use at most {MAX_TABLES} tables")
        known, total = {}, 0
        for name in names:
            got = self.resolve(*name)
            if got is None:
                raise NotFound(f"table not found: {'.'.join(name)}")
            known[name], size = got
            total += size
            if size > MAX_TABLE_BYTES or total > MAX_TOTAL_BYTES:
                raise TooLarge("tables are too large for this surface")
        return _run(spark, parsed, known)


def _run(spark: SparkSession, parsed: Parsed, known: dict) -> DataFrame:
    try:
        df = _bind(spark, parsed, known)
    except (AnalysisException, ParseException) as e:
        raise QueryError(str(e)) from e
    return df.limit(MAX_ROWS)


def collect(df: DataFrame, form: str = "arrow", timeout_s: float = TIMEOUT_S) -> bytes:
    """Encoded result under the time and size limits: an Arrow stream or a JSON array."""
    if form not in ("arrow", "json"):
        raise QueryError("format must be json or arrow")
    spark = df.sparkSession
    tag = f"gate-{uuid.uuid4().hex}"
    hit = threading.Event()

    def stop() -> None:
        hit.set()
        spark.interruptTag(tag)

    most = MAX_RESULT_BYTES if form == "arrow" else 8 * MAX_RESULT_BYTES
    size = spark.conf.get(_BATCH_BYTES)
    timer = threading.Timer(timeout_s, stop)
    spark.addTag(tag)
    spark.conf.set(_BATCH_BYTES, str(1 << 20))
    timer.start()
    try:
        # one task holds the limited result; past the bound it stops, and the driver gets no more
        table = df.coalesce(1).mapInArrow(_up_to(most), df.schema).toArrow()
    except Exception as e:
        raise (TimedOut("query timed out") if hit.is_set() else QueryError(str(e)) if isinstance(e, AnalysisException) else InternalError(str(e))) from e
    finally:
        timer.cancel()
        spark.conf.set(_BATCH_BYTES, size)
        spark.removeTag(tag)
    body = b"" if table.nbytes > most else encode(table, form)
    if table.nbytes > most or len(body) > MAX_RESULT_BYTES:
        raise TooLarge("result is too large")
    return body


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _up_to(most: int):
    """Passes batches on until ``most`` bytes are exceeded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            yield batch
            total += batch.nbytes
            if total > most:
                return

    return run


def encode(table: pa.Table, form: str) -> bytes:
    if form == "json":
        import json

        return json.dumps(table.to_pylist(), default=str, separators=(",", ":")).encode()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def wanted_format(query_format: str | None, accept: str | None) -> str:
    """The format parameter beats the Accept header; Arrow is the default."""
    if query_format is not None:
        if query_format not in ("json", "arrow"):
            raise QueryError("format must be json or arrow")
        return query_format
    return "json" if accept and "application/json" in accept.lower() else "arrow"


def nulls_last(order: str) -> str:
    """An ORDER BY list with other dialects' null placement made explicit: nulls last for
    ascending keys, first for descending ones."""
    out = []
    for key in order.split(","):
        k = key.strip()
        if "nulls" not in k.lower():
            k += " NULLS FIRST" if k.lower().endswith(" desc") else " NULLS LAST"
        out.append(k)
    return ", ".join(out)


#: Names other dialects use, with Spark's; those that differ in more than name are not here.
RENAMED = {"strpos": "instr", "starts_with": "startswith", "ends_with": "endswith", "substr_index": "substring_index", "array_has": "array_contains", "array_has_any": "arrays_overlap", "array_length": "array_size", "array_indexof": "array_position", "array_to_string": "array_join", "string_to_array": "split", "make_array": "array", "generate_series": "sequence", "array_concat": "concat", "array_element": "try_element_at", "unnest": "explode", "row": "struct", "map_extract": "element_at", "arrow_typeof": "typeof", "var": "var_samp", "covar": "covar_samp", "approx_distinct": "approx_count_distinct", "approx_percentile_cont": "approx_percentile", "datetrunc": "date_trunc", "datepart": "date_part", "to_timestamp_millis": "timestamp_millis", "to_timestamp_micros": "timestamp_micros", "to_timestamp_seconds": "timestamp_seconds", "to_unixtime": "unix_timestamp", "today": "current_date", "list_distinct": "array_distinct", "list_sort": "array_sort", "regexp_match": "regexp_extract_all"}


def translate_functions(sql: str) -> str:
    """``sql`` with other dialects' function names replaced, outside quotes."""
    import re

    names = "|".join(sorted(RENAMED, key=len, reverse=True))
    pattern = re.compile(rf"(?i)(?<![\w.`])({names})(?=\s*\()")
    pieces = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if k % 2 else pattern.sub(lambda m: RENAMED[m[1].lower()], p) for k, p in enumerate(pieces))


_RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


def bind_views(spark: SparkSession, parsed: Parsed, tables: dict[tuple[str, ...], DataFrame]) -> DataFrame:
    """The whole result, without the row limit of the query surfaces.  Spark's own limit on
    the rows of a recursion counts when the plan runs, so a recursive query runs here, with
    the limit lifted just for it, into the checkpoint folder; the limit on levels stays."""
    df = _bind(spark, parsed, tables)
    if not parsed.recursive:
        return df
    rows = spark.conf.get(_RECURSION_ROWS)
    spark.conf.set(_RECURSION_ROWS, "-1")
    try:
        return cut(df)
    finally:
        spark.conf.set(_RECURSION_ROWS, rows)
