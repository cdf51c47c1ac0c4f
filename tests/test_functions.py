import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lakelens.functions import cron, encoded
from lakelens.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_partition_key_vector(spark):
    key = S.partition_key({"region": S.scalar_string(F.lit("us-east")), "date": S.scalar_date(F.lit("2025-01-15").cast("date"))})
    assert one(spark, key) == "date=d:2025-01-15,region=s:dXMtZWFzdA"


@pytest.mark.parametrize("text,strict,want", [
    ("date=d:2025-01-15,region=s:dXMtZWFzdA", True, {"date": "d:2025-01-15", "region": "s:dXMtZWFzdA"}),
    ("region=us-east", True, None),
    ("region=us-east", False, {"region": "s:dXMtZWFzdA"}),
    ("Region=s:eA", True, None),
    ("", True, None),
])
def test_parse_partition_key(spark, text, strict, want):
    assert one(spark, S.parse_partition_key(F.lit(text), strict)) == want


def test_decode_scalar(spark):
    assert one(spark, S.decode_scalar(S.scalar_string(F.lit("a/b é")))) == "a/b é"
    assert one(spark, S.decode_scalar(F.lit("n:null"))) is None
    assert one(spark, S.decode_scalar(F.lit("i:-5"))) == "-5"


@pytest.mark.parametrize("text,loose,strict", [("2023-02-29", True, False), ("2024-02-29", True, True), ("1969-01-01", False, False), ("2024-04-31", False, False), ("x", False, False)])
def test_date_literals(spark, text, loose, strict):
    assert one(spark, S.is_date_literal(F.lit(text))) is loose
    assert one(spark, S.is_date_literal(F.lit(text), any_leap_day=False)) is strict


def test_timestamp_literal(spark):
    assert one(spark, S.is_timestamp_literal(F.lit("2024-01-02T03:04:05.123456Z")))
    assert not one(spark, S.is_timestamp_literal(F.lit("2024-01-02T25:04:05.123456Z")))


def test_tokens_split_on_other_letters(spark):
    assert one(spark, S.tokens(F.lit("Ein größerer foo_bar x 9a"))) == ["Ein", "gr", "erer", "foo_bar", "9a"]


def test_request_fingerprint(spark):
    import hashlib

    assert one(spark, S.request_fingerprint(F.array(F.lit("a"), F.lit("b")))) == hashlib.sha256(b"a|b|").hexdigest()[:32]


def test_edge_id_is_injective(spark):
    ids = [one(spark, S.edge_id("t", F.lit(a), F.lit(b), F.lit("k"), F.lit(r).cast("string"))) for a, b, r in (("a", "bc", None), ("ab", "c", None), ("a", "bc", ""), ("a", "bc", "r"))]
    assert len(set(ids)) == 4


def test_edge_validation(spark):
    ok = lambda a, k="k": one(spark, S.valid_edge(F.lit(a), F.lit("b"), F.lit(k), F.lit(None).cast("string")))
    assert ok("a") and not ok("") and not ok("a\n") and not ok("é" * 129) and not ok("a", "k" * 65)


def test_timer_ids(spark):
    got = one(spark, S.parse_timer_id(S.timer_id("retry", F.lit("run"), F.lit("a.b"), F.lit(2), F.lit(99))))
    assert (got.kind, got.run_id, got.task_key, got.attempt, got.fire_at) == ("retry", "run", "a.b", 2, 99)
    got = one(spark, S.parse_timer_id(F.lit("timer:cron:daily:123")))
    assert (got.kind, got.schedule_id, got.fire_at, got.run_id) == ("cron", "daily", 123, None)
    assert one(spark, S.parse_timer_id(F.lit("other"))).kind is None
    assert encoded.parse_timer("timer:cron:d:7") == {"timer_type": "CRON", "run_id": None, "task_key": None, "attempt": None, "fire_at": 7000}
    assert encoded.parse_timer("timer:retry:r:t:x:7") is None


def test_ulid(spark):
    assert one(spark, S.ulid_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259 == encoded.millis_of_ulid("01ARZ3NDEKTSV4RRFFQ69G5FAV")
    assert one(spark, S.ulid_millis(F.lit("nope"))) is None and encoded.millis_of_ulid("nope") is None


@pytest.mark.parametrize("text,want", [
    ("S3://Bucket/a//b/", "s3://bucket/a/b"), ("gs://x", "gs://x"), ("a/b", None), ("s3://b/../c", None), ("s3://b/c?x=1", None),
])
def test_uris(spark, text, want):
    assert one(spark, S.canonical_uri(F.lit(text))) == want


def test_scoped_location(spark):
    at = lambda x: one(spark, S.scoped_location(F.lit(x), "t", "w"))
    assert at("tenant=t/workspace=w/a.parquet") == "a.parquet" and at("a/b.parquet") == "a/b.parquet"
    assert at("tenant=o/workspace=w/a.parquet") is None and at("s3://x/a.parquet") is None and at("a/../b") is None


def test_redaction(spark):
    assert one(spark, S.redact_url(F.lit("https://h/p?a=1&X-Goog-Signature=abc&sig=d#f"))) == "https://h/p?a=1&X-Goog-Signature=REDACTED&sig=REDACTED#f"


def test_canonical_json():
    assert encoded.canonical_json({"b": [1, {"z": None, "a": "é"}], "a": -1}) == '{"a":-1,"b":[1,{"a":"é","z":null}]}'
    with pytest.raises(ValueError):
        encoded.canonical_json({"a": 1.5})


def test_python_functions(spark):
    assert encoded.task_name("d", "x") == one(spark, encoded.task_name_udf("d")(F.lit("x")))
    assert len(encoded.run_id("t", "w", "k", b"s")) == 30
    assert encoded.run_id("t", "w", "k", b"s") == one(spark, encoded.run_id_udf("t", "w", b"s")(F.lit("k")))
    assert one(spark, encoded.canonical_json_udf()(F.lit('{"b":1, "a":2}'))) == '{"a":2,"b":1}'
    assert one(spark, encoded.canonical_json_udf()(F.lit("{bad"))) is None
    assert 0 <= encoded.full_jitter("r", "t", 3) <= 20_000


def test_date_bin_and_names(spark):
    ts = F.lit("2024-01-01 10:17:00").cast("timestamp")
    assert one(spark, S.date_bin(900, ts)) == dt.datetime(2024, 1, 1, 10, 15)
    assert one(spark, S.canonical_asset_key(F.lit("ns/a.b"))) == "ns.a.b"
    assert one(spark, S.canonical_asset_key(F.lit("Bad/x"))) is None
    assert one(spark, S.table_format(F.lit(" Delta "))) == "delta" and one(spark, S.table_format(F.lit(None).cast("string"))) == "parquet"
    assert one(spark, S.table_format(F.lit("orc"))) is None
    assert one(spark, S.first_label(F.create_map(F.lit("run_kind"), F.lit("x")), "kind", "run_kind")) == "x"


UTC = ZoneInfo("UTC")


def times(expression, a, z, zone="UTC"):
    return [t.isoformat() for t in cron.Cron(expression).times(a, z, ZoneInfo(zone))]


def test_cron_fields():
    a, z = dt.datetime(2024, 1, 1, tzinfo=dt.UTC), dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    assert len(times("*/15 8-9 * * *", a, z)) == 8
    assert times("0 0 12 1 jan *", a, z) == ["2024-01-01T12:00:00+00:00"]
    assert times("0 0 * * sun", a, z) == []
    for bad in ("* * * *", "61 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(cron.CronError):
            cron.Cron(bad)


def test_cron_across_clock_changes():
    a, z = dt.datetime(2024, 3, 30, 23, tzinfo=dt.UTC), dt.datetime(2024, 3, 31, 23, tzinfo=dt.UTC)
    assert times("30 2 * * *", a, z, "Europe/Berlin") == []  # 02:30 does not exist
    a, z = dt.datetime(2024, 10, 26, 23, tzinfo=dt.UTC), dt.datetime(2024, 10, 27, 23, tzinfo=dt.UTC)
    assert times("30 2 * * *", a, z, "Europe/Berlin") == ["2024-10-27T00:30:00+00:00"]


def test_due_ticks():
    now = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
    ticks, error = cron.due_ticks("0 * * * *", "UTC", now - dt.timedelta(hours=5), now, 180, 10)
    assert error is None and [t.hour for t in ticks] == [10, 11, 12]
    assert cron.due_ticks("bad", "UTC", None, now, 60, 5)[1] and cron.due_ticks("0 * * * *", "No/Zone", None, now, 60, 5)[1]
