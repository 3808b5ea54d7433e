"""Every stage of the pipeline on its own input against a plain version, over the smallest tables."""

import hashlib

import duckdb
import pyarrow.parquet as pq
from test_native import low
from test_similar import brute_classes

import corpus_pipeline
from fieldscan.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "encoding"]
    columns = pq.read_schema(f"{FOLDER}/documents.parquet").names
    tables = [pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "encoding" or docs.columns == columns
        tables.append(pq.read_table(f"{tmp_path}/{k}").to_pylist())
    ids = [{r["doc_id"] for r in t} for t in tables]
    assert all(len(i) == len(t) for i, t in zip(ids, tables)) and ids[0] > ids[1] > ids[2]

    toxic = {r["doc_id"] for r in queries.op6_toxicity(spark, FOLDER).collect() if r["predicted"]}
    assert ids[1] == ids[0] - toxic
    best: dict = {}
    for r in tables[1]:
        best[low(r["text"])] = max(r["doc_id"], best.get(low(r["text"]), -1))
    assert ids[2] == set(best.values())
    rows = sorted(tables[2], key=lambda r: r["doc_id"])
    classes = brute_classes([r["text"] for r in rows])
    assert ids[3] == {rows[c]["doc_id"] for c in classes}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")
    con.execute(f"CREATE VIEW numbered AS SELECT row_number() OVER () AS rid, * FROM '{tmp_path}/2/*.parquet'")
    leaks = {r[0] for r in con.execute(f"WITH {queries.leaks_sql('numbered')} SELECT doc_id FROM leaks").fetchall()}
    assert leaks and ids[4] == ids[3] - leaks
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in tables[4]}
    for r in tables[5]:
        want = tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()

    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in whole} == {(r["doc_id"], r["n_tokens"]) for r in tables[5]}


def test_pipeline_on_nulls_and_nothing(spark, tmp_path):
    """Null texts and ids, repeated rows and columns whose names clash go through; of what is equal one row stays."""
    docs = [(1, None, 7, "x"), (2, "", 7, "x"), (3, "Plain words about rivers and hills", None, None), (3, "Plain words about rivers and hills", None, None), (None, "other words", 1, "y")]
    schema = "doc_id long, text string, rid long, RID_ string, source string, lang string, n_chars long"
    frame = spark.createDataFrame([(*d, None, None, None) for d in docs], schema)
    for name, rows in (("full", frame), ("none", frame.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = {(r["doc_id"], r["n_tokens"] > 0) for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()}
    assert got == {(2, False), (3, True), (None, True)}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
