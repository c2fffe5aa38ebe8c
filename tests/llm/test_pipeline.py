import re

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from helixframe.llm import secret_scan

SF = "/root/testdata/sf0.001"


def through(spark, docs, folder):
    """Each stage's output, written and read again."""
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        yield name, docs


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(through(spark, docs, tmp_path))
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES]
    for name, out in list(stages.items())[:-1]:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
    told = {r.doc_id: r.text for r in stages["language_id"].collect()}
    assert told == {d: t for d, t in before.items() if any(map(str.isalpha, t))}  # clean documents stay as they were
    lines = {r.doc_id: r.text for r in stages["line_dedup"].collect()}
    want = {d: kept for d, n, dropped, kept in brute.dedup_lines(sorted(told.items())) if dropped < n}
    assert lines == want
    kept = {r.doc_id: r.text for r in stages["simhash_dedup"].collect()}
    assert all(lines[d] == t for d, t in kept.items()) and len(set(kept.values())) == len(kept)

    def shingles(t):
        w = brute.WORDS.findall(t.translate(brute.ASCII_LOWER))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in lines.items()}
    for d in set(lines) - set(kept):
        assert max(len(sets[d] & s) / len(sets[d] | s) for e, s in sets.items() if e != d) > 0.6, d  # nothing clean goes
    stay = sorted(kept)
    assert not [(a, b) for i, a in enumerate(stay) for b in stay[:i] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.9]
    clean = {r.doc_id: r.text for r in stages["secret_scan"].collect()}
    assert set(clean) == set(kept)
    for d, t in clean.items():
        assert not [s for s in secret_scan.find_spans(t) if s[0] != "random"]
        if "[SECRET]" not in t:
            assert t == kept[d]
    packed = stages["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(clean)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t for r in sums)


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_odd_documents_pass_through(request, spark, tmp_path, which):
    docs = request.getfixturevalue(which)
    stages = dict(through(spark, docs, tmp_path))
    left = stages["secret_scan"].collect()
    if which == "odd_documents":
        assert {r.doc_id for r in left} >= {-5, 1, 6, 8} and not {r.doc_id for r in left} & {3, 4, 5, 9}
        assert any(r.doc_id is None for r in left)
    else:
        assert not left


def test_registration():
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n in names if re.match(r"op\d", n)] == [f"op{k}_{x}" for k, x in enumerate(("language_id", "secret_scan", "embedding_dedup", "media_copies", "simhash_dedup", "packing", "token_files", "line_dedup", "substring_dedup", "byte_bpe"), 1)]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
