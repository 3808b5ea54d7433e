"""Rows stay the same rows when the number of splits changes between the jobs of an operator, as it does with the cores of a cluster."""

import itertools

import pytest

from fieldscan.llm import common, components, decontam, exact_dedup, line_dedup, merkle, near_dedup, queries, toxicity, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def shaken(spark, monkeypatch):
    """Every stored table is followed by another default parallelism."""
    cores, write = itertools.cycle([2, 13, 5, 29]), common.cut

    def cut(*args, **kwargs):
        out = write(*args, **kwargs)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores))
        return out

    for module in (common, components, decontam, exact_dedup, line_dedup, merkle, near_dedup, toxicity, warc):
        monkeypatch.setattr(module, "cut", cut)
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_kept_rows_follow_their_content(spark, tmp_path, shaken):
    queries.table(spark, FOLDER, "documents").repartition(16).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    exact = {r["doc_id"] for r in exact_dedup.exact_duplicates(docs).where("kept").collect()}
    assert {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()} == exact
    near = {r["doc_id"] for r in near_dedup.near_classes(docs).where("kept").collect()}
    assert {r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()} == near
    bench = queries.table(spark, FOLDER, "benchmark")
    leaks = {r["doc_id"] for r in decontam.find_leaks(docs, bench).collect()}
    every = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert leaks and {r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()} == every - leaks


def test_revisits_follow_their_content(spark, tmp_path, shaken):
    rows = [(i % 7, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9).write.parquet(f"{tmp_path}/p")
    warc.write_archives(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/w")
    out = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert len(out) == 60 and not [r for r in out if r["problem"]]
    assert sorted(r["page_id"] for r in out) == sorted(str(i) for i, *_ in rows)
    same = [r for r in out if r["payload_bytes"] == 4]
    assert [r["page_id"] for r in same if r["record_type"] == "response"] == ["0"]
    assert all(r["refers_to"] == "0" for r in same if r["record_type"] == "revisit")


def test_lines_and_proofs_follow_their_content(spark, tmp_path):
    queries.table(spark, FOLDER, "documents").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    want = [sorted(map(tuple, q(spark, FOLDER).collect())) for q in (queries.op11_merkle, queries.op12_line_dedup)]
    assert [sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (queries.op11_merkle, queries.op12_line_dedup)] == want


def test_lines_and_proofs_when_splits_change(spark, tmp_path, shaken):
    test_lines_and_proofs_follow_their_content(spark, tmp_path)
