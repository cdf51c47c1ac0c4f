"""The thin queries: their columns, and the parts of their rows that SQL can tell."""

import pytest

from lakelens.llm import queries
from tests.test_oracles import plain

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_karmarkar_karp_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What SQL can say of an operator's rows.
PARTS = {
    "op3_karmarkar_karp_sharding": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "op4_lm_scoring": f"SELECT doc_id, CAST(len({_WORDS.format(_LOWER)}) + 1 AS BIGINT) AS n_tokens FROM documents",
    "op7_quality_rules": f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM (SELECT *, {_WORDS.format("coalesce(text, '')")} AS w FROM documents)""",
    "op9_source_mixing": rf"""WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
        s AS (SELECT source, sum(size) AS n, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM d GROUP BY source),
        level AS (SELECT max(l) AS l FROM (SELECT (1.5 * (SELECT sum(n) FROM s) - coalesce(sum(2.0 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s))
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, round(least(2.0 * n, level.l * w), 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, level""",
}


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = queries.queries()[name](spark, SF).persist()
        return found[name]

    return get


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, results, name):
    got = results(name)
    have = [f"{k} {t}" for k, t in got.dtypes]
    assert [x for x in COLUMNS[name].split(", ") if x not in have] == []
    table = "embeddings" if name.startswith("op6") else "documents"
    ids = spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith("op6"):
        assert got.count() == 5 * ids.where("vec_id % 50 = 0").count()
    else:
        assert got.select("doc_id").distinct().count() == ids.count()


def same(got, want):
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    left = sorted(tuple(plain(round(r[c], 3) if isinstance(r[c], float) else r[c]) for c in cols) for r in got.collect())
    assert left == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", PARTS)
def test_parts_by_sql(duck, results, name):
    same(results(name), duck.sql(PARTS[name]))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_by_sql(duck, results, name):
    same(results(name), duck.sql(queries.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_columns_are_those_of_the_sql(duck, results, name):
    assert results(name).columns == duck.sql(queries.oracle_sql()[name]).columns


def test_shards_are_even_and_numbered(results):
    rows = results("op3_karmarkar_karp_sharding").collect()
    loads, slots = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots)
    largest = max(r.size for r in rows)
    assert max(loads) - min(loads) <= max(0.01 * sum(loads) / 16, largest)


def test_taken_words_come_near_the_targets(results):
    rows = results("op9_source_mixing").collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - target) <= max(2, 0.01 * target) for (_, target), v in by.items())
