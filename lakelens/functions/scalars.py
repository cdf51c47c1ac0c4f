"""Scalar functions of the metadata layer, as Spark column expressions.

All of these stay inside whole-stage code generation; the few that need a hash
Spark lacks are Arrow-batched and live in ``encoded``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- text search ---------------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """Words of ASCII letters, digits and underscores, two characters or more, in order."""
    return F.filter(F.split(_c(text), "[^A-Za-z0-9_]"), lambda x: F.length(x) >= 2)


def token_norm(token: Column | str) -> Column:
    """ASCII lower case; other letters never occur in a token."""
    return F.lower(_c(token))


# -- partition keys ------------------------------------------------------------


def base64url(x: Column | str) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.rtrim(F.base64(F.encode(_c(x), "UTF-8")), F.lit("=")), "+/\r\n", "-_")


def scalar_string(x: Column | str) -> Column:
    return F.concat(F.lit("s:"), base64url(x))


def scalar_int(x: Column | str) -> Column:
    return F.concat(F.lit("i:"), _c(x).cast("long").cast("string"))


def scalar_bool(x: Column | str) -> Column:
    return F.concat(F.lit("b:"), _c(x).cast("boolean").cast("string"))


def scalar_date(x: Column | str) -> Column:
    return F.concat(F.lit("d:"), F.date_format(_c(x), "yyyy-MM-dd"))


def scalar_timestamp(x: Column | str) -> Column:
    """Microsecond UTC timestamps."""
    return F.concat(F.lit("t:"), F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def scalar_null() -> Column:
    return F.lit("n:null")


def or_null(original: Column | str, encoded: Column) -> Column:
    """``encoded`` where the value is there, else the encoded null."""
    return F.when(_c(original).isNull(), scalar_null()).otherwise(encoded)


DIMENSION = "[a-z][a-z0-9_]*"


def partition_key(dims: dict[str, Column]) -> Column:
    """``k=v`` of already encoded scalars, joined by commas in order of the dimension."""
    parts = [F.concat(F.lit(f"{k}="), dims[k]) for k in sorted(dims)]
    return F.concat_ws(",", *parts)


def partition_key_of_map(dims: Column | str) -> Column:
    """The same from a map column."""
    entries = F.array_sort(F.map_entries(_c(dims)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def parse_partition_key(key: Column | str, strict: bool = True) -> Column:
    """Map of dimension to encoded scalar; null if malformed.  Where not strict, values
    without a tag are taken as strings."""
    k = _c(key)
    value = r"(s:[A-Za-z0-9_-]*|i:-?[0-9]+|b:(true|false)|d:[0-9]{4}-[0-9]{2}-[0-9]{2}|t:[0-9T:.-]+Z|n:null)"
    one = f"{DIMENSION}={value if strict else '[^,=]+'}"
    pairs = F.str_to_map(k, F.lit(","), F.lit("="))
    fixed = pairs if strict else F.transform_values(
        pairs, lambda _, v: F.when(v.rlike(f"^{value}$"), v).otherwise(scalar_string(v))
    )
    return F.when(k.rlike(f"^{one}(,{one})*$"), fixed)


def decode_scalar(x: Column | str) -> Column:
    """The plain text inside an encoded scalar; null for an encoded null."""
    s = _c(x)
    tag, body = F.substring(s, 1, 2), F.substring(s, 3, 1 << 30)
    return F.when(s == "n:null", F.lit(None)).when(
        tag == "s:", F.decode(F.unbase64(F.translate(body, "-_", "+/")), "UTF-8")
    ).otherwise(body)


def fingerprint(x: Column | str) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(_c(x), 256)


def time_dimension(ts: Column | str, granularity: str) -> Column:
    """Canonical text of a time at a granularity."""
    form = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH':00:00Z'"}[granularity]
    return F.date_format(_c(ts), form)


def is_date_literal(x: Column | str, any_leap_day: bool = True) -> Column:
    """A day from 1970 on.  With ``any_leap_day`` 29 February passes in every year, as in
    the original format; else it must exist."""
    s = _c(x)
    shape = s.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$")
    year, month, day = (F.substring(s, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    most = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, 29).otherwise(31)
    ok = shape & (year >= 1970) & (day <= most)
    if not any_leap_day:
        ok &= s.try_cast("date").isNotNull()
    return F.coalesce(ok, F.lit(False))


def is_timestamp_literal(x: Column | str, any_leap_day: bool = True) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` with a valid day."""
    s = _c(x)
    clock = s.rlike(r"^.{10}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{6}Z$")
    return F.coalesce(clock, F.lit(False)) & is_date_literal(F.substring(s, 1, 10), any_leap_day)


# -- ids and fingerprints ------------------------------------------------------


def request_fingerprint(keys: Column | str) -> Column:
    """SHA-256 over each key and a bar, the first 16 bytes in hex."""
    bars = F.concat(F.array_join(_c(keys), "|"), F.when(F.size(_c(keys)) > 0, F.lit("|")).otherwise(F.lit("")))
    return F.substring(F.sha2(bars, 256), 1, 32)


def _length_prefixed(x: Column) -> Column:
    size = F.unhex(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0"))
    return F.concat(size, F.encode(x, "UTF-8"))


def edge_id(tag: str, source: Column | str, target: Column | str, kind: Column | str, run: Column | str) -> Column:
    """SHA-256 over a tag and the length-prefixed fields; a byte tells whether there is a run."""
    run = _c(run)
    present = F.when(run.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _length_prefixed(run)))
    fields = [F.encode(F.lit(tag), "UTF-8"), *(_length_prefixed(_c(x)) for x in (source, target, kind)), present]
    return F.sha2(F.concat(*fields), 256)


def valid_edge(source: Column | str, target: Column | str, kind: Column | str, run: Column | str) -> Column:
    """Ids and runs of 1 to 256 bytes, kinds of 1 to 64, no control characters."""
    def ok(x: Column, most: int) -> Column:
        n = F.octet_length(x)
        return (n >= 1) & (n <= most) & ~x.rlike(r"\p{Cntrl}")

    run = _c(run)
    every = ok(_c(source), 256) & ok(_c(target), 256) & ok(_c(kind), 64) & (run.isNull() | ok(run, 256))
    return F.coalesce(every, F.lit(False))


def dispatch_id(run: Column | str, task: Column | str, attempt: Column | str) -> Column:
    return F.concat_ws(":", F.lit("dispatch"), _c(run), _c(task), _c(attempt).cast("string"))


def attempt_id(run: Column | str, task: Column | str, attempt: Column | str) -> Column:
    """Follows from the dispatch, so repeated dispatches agree on it."""
    return F.concat(F.lit("att_"), F.substring(F.sha2(dispatch_id(run, task, attempt), 256), 1, 24))


def timer_id(kind: str, *parts: Column | str) -> Column:
    """``timer:<kind>:…``: retry and heartbeat take run, task, attempt, time; cron takes
    schedule, time."""
    return F.concat_ws(":", F.lit("timer"), F.lit(kind), *(_c(p).cast("string") for p in parts))


def parse_timer_id(x: Column | str) -> Column:
    """Struct of kind, run_id, task_key, attempt, schedule_id, fire_at (epoch seconds)."""
    s = _c(x)
    task = r"^timer:(retry|heartbeat|sla):([^:]+):(.+):([0-9]+):([0-9]+)$"
    cron = r"^timer:(cron):(.+):([0-9]+)$"
    part = lambda pattern, i: F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))
    return F.struct(
        F.coalesce(part(task, 1), part(cron, 1)).alias("kind"),
        part(task, 2).alias("run_id"),
        part(task, 3).alias("task_key"),
        part(task, 4).cast("int").alias("attempt"),
        part(cron, 2).alias("schedule_id"),
        F.coalesce(part(task, 5), part(cron, 3)).cast("long").alias("fire_at"),
    )


#: Crockford's base-32 alphabet.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(x: Column | str) -> Column:
    """Epoch milliseconds in the first ten characters of a ULID; null if malformed."""
    s = F.upper(_c(x))
    value = F.lit(0).cast("long")
    for i in range(1, 11):
        value = value * 32 + (F.position(F.substring(s, i, 1), F.lit(CROCKFORD)) - 1).cast("long")
    return F.when(s.rlike(f"^[0-7][{CROCKFORD}]{{25}}$"), value)


# -- retries, lag and money ----------------------------------------------------


def retry_backoff_seconds(attempt: Column | str) -> Column:
    """30 s doubled each attempt after the first, six times at most, 900 s at most."""
    doublings = F.least(F.greatest(_c(attempt) - 1, F.lit(0)), F.lit(6))
    return F.least(F.lit(900), F.lit(30) * F.pow(F.lit(2), doublings)).cast("long")


def backpressure(written: Column | str, compacted: Column | str, soft: int, hard: int) -> Column:
    """Struct of lag, decision (ACCEPT, WARN, REJECT) and seconds to wait."""
    lag = F.greatest(_c(written) - _c(compacted), F.lit(0)).cast("long")
    wait = F.least(F.lit(60), F.lit(5) + F.floor((lag - hard) / hard)).cast("long")
    return F.struct(
        lag.alias("lag"),
        F.when(lag >= hard, "REJECT").when(lag >= soft, "WARN").otherwise("ACCEPT").alias("decision"),
        F.when(lag >= hard, wait).alias("retry_after_s"),
    )


# -- names and places ----------------------------------------------------------


def canonical_asset_key(x: Column | str) -> Column:
    """``ns.name`` from ``ns.name`` or ``ns/name``; null if malformed.  Only names may hold dots."""
    s = F.regexp_replace(_c(x), "^([^/.]*)/", "$1.")
    return F.when(s.rlike(rf"^{DIMENSION}(\.{DIMENSION})+$"), s)


def asset_namespace_table(x: Column | str) -> Column:
    """Struct (namespace, table): cut at the first slash, else the first dot; an empty part
    is null."""
    s = _c(x)
    slash, dot = F.instr(s, "/"), F.instr(s, ".")
    at = F.when(slash > 0, slash).otherwise(dot)
    empty = lambda y: F.nullif(y, F.lit(""))
    return F.struct(
        F.when(at > 0, empty(s.substr(F.lit(1), at - 1))).alias("namespace"),
        F.when(at > 0, empty(s.substr(at + 1, F.length(s)))).otherwise(empty(s)).alias("table"),
    )


def first_label(labels: Column | str, *names: str) -> Column:
    """The first of several alias keys that a label map has."""
    return F.coalesce(*(F.element_at(_c(labels), F.lit(n)) for n in names))


def canonical_uri(x: Column | str) -> Column:
    """Scheme and authority in lower case, no repeated or trailing slashes; null for
    relative paths and for paths with dot segments."""
    s = F.trim(_c(x))
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    ok = (scheme != "") & ~path.rlike(r"(^|/)\.{1,2}(/|$)") & ~s.rlike(r"[?#]")
    return F.when(ok, F.concat(scheme, F.lit("://"), authority, path))


def path_covers(outer: Column | str, inner: Column | str) -> Column:
    """Whether a canonical path is another's ancestor or itself."""
    return (_c(outer) == _c(inner)) | F.startswith(_c(inner), F.concat(_c(outer), F.lit("/")))


def scoped_location(x: Column | str, tenant: str, workspace: str) -> Column:
    """Location inside ``tenant=…/workspace=…/``; null for URIs and other tenants' paths."""
    s = F.regexp_replace(_c(x), "^/+", "")
    prefix = f"tenant={tenant}/workspace={workspace}/"
    inside = F.when(F.startswith(s, F.lit(prefix)), s.substr(F.lit(len(prefix) + 1), F.length(s)))
    return F.when(s.contains("://") | s.rlike(r"(^|/)\.\.(/|$)"), F.lit(None)).when(s.rlike("^tenant="), inside).otherwise(s)


def table_format(x: Column | str, default: str = "parquet") -> Column:
    """Lower-cased format; the default where null; null if it isn't one of the three."""
    f = F.coalesce(F.lower(F.trim(_c(x))), F.lit(default))
    return F.when(f.isin("delta", "iceberg", "parquet"), f)


#: Query parameters whose values never leave the engine.
SENSITIVE_PARAMETERS = ("sig", "signature", "token", "x-id-token", "se", "sp", "sr", "sv", "skoid", "sktid", "skt", "ske", "sks", "skv")
SENSITIVE_PREFIXES = ("x-amz-", "x-goog-", "x-ms-")


def redact_url(x: Column | str) -> Column:
    """Values of sensitive query parameters replaced."""
    names = "|".join([*SENSITIVE_PARAMETERS, *(f"{p}[^=&#]*" for p in SENSITIVE_PREFIXES)])
    return F.regexp_replace(_c(x), rf"(?i)([?&](?:{names})=)[^&#]*", "$1REDACTED")


# -- times ---------------------------------------------------------------------


def rfc3339(millis: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_c(millis)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def inclusive_days(start: Column | str, end: Column | str) -> Column:
    """Days from the earlier to the later bound, both counted."""
    a, b = _c(start), _c(end)
    return F.datediff(F.greatest(a, b), F.least(a, b)) + 1


# -- functions other SQL dialects have -----------------------------------------


def date_bin(seconds: int, ts: Column | str) -> Column:
    """Start of the bin a time falls in, bins counted from 1970."""
    s = F.unix_timestamp(F.to_timestamp(_c(ts)))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def gcd(a: Column | str, b: Column | str) -> Column:
    """Greatest common divisor by Euclid's steps, unrolled past the worst 64-bit case."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        F.struct(F.abs(_c(a)).cast("long").alias("x"), F.abs(_c(b)).cast("long").alias("y")),
        lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))),
    )
    return steps["x"]


def lcm(a: Column | str, b: Column | str) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, 0).otherwise(F.abs(_c(a) / g).cast("long") * F.abs(_c(b)))
