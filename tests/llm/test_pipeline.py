from collections import Counter, defaultdict

import corpus_pipeline as cp
from lakelens.llm import linecrf, mixing, secrets
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, kept = docs.columns, [docs.count()], [docs.collect()]
    assert len(cp.STAGES) == 5
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == columns, name
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] and sizes[5] >= sizes[4]
    assert cp.run(spark, SF).count() == sizes[5]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    good = linecrf.score(first, linecrf.train(first, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept")
    assert sorted(r.doc_id for r in kept[1]) == sorted(r.doc_id for r in good.collect())
    # one document of each group of near copies, by full sets
    groups = brute([(r.doc_id, r.text, r.source) for r in kept[1]], percent=80)
    assert sorted(r.doc_id for r in kept[2]) == sorted({comp for comp, _ in groups.values()})
    # no secret is left, all else is as it was
    report = secrets.report(spark.read.parquet(str(tmp_path / "2")))
    assert report.where("spans <> ''").count() == 0
    before, clean = {r.doc_id: r.text for r in kept[2]}, {r.doc_id for r in secrets.report(spark.read.parquet(str(tmp_path / "1"))).where("spans = ''").collect()}
    assert clean and all(r.text == before[r.doc_id] for r in kept[3] if r.doc_id in clean)
    # whole documents, as often as the mix takes them
    mix = {r.doc_id: r for r in mixing.mix(spark, spark.read.parquet(str(tmp_path / "2"))).collect()}
    times, texts = Counter(r.doc_id for r in kept[4]), {r.doc_id: r.text for r in kept[3]}
    assert all(times[i] == (int(r.taken / r.size + 0.5) if r.size else 0) for i, r in mix.items()) and all(r.text == texts[r.doc_id] for r in kept[4])
    # every piece has its place in a sequence
    pieces, sequences = Counter(r.doc_id for r in kept[5] if r.piece == 0), defaultdict(list)
    assert pieces == times
    for r in kept[5]:
        sequences[r.sequence_id].append((r.offset, r.length))
    for rows in sequences.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and sum(rows[-1]) <= 1024


def test_entry_without_llm():
    """The entry point imports where the subpackage is gone, and only then."""
    import importlib
    import subprocess
    import sys
    from pathlib import Path

    root = Path(importlib.import_module("corpus_pipeline").__file__).parent
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('lakelens.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
