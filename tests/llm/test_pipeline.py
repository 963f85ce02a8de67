"""The pipeline against its stages' contracts, worked out by brute force from each stage's own input."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_contamination, tokenizers


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    library = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        from tessera.llm.shared import stored

        docs = stored(stage(spark, docs, data), f"test-{name}")
        if name == "tokens":
            break
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert kept.items() <= texts.items()
        if name == "exact_dedup":
            last = {t: i for i, t in sorted(texts.items())}
            assert set(kept) == set(last.values())
        if name == "near_dedup":
            assert set(kept) == {c for _, c in brute_components(texts.items()).values()}
        if name == "decontamination":
            assert set(kept) == {i for i, w in brute_contamination(texts.items(), benchmark).items() if not w[4]}
        texts = kept
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in docs.collect()}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_sql_twins(spark, data):
    import duckdb

    from tessera.llm import queries
    from tests.test_catalog import rows_of

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, data), con.sql(sql)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall()), name
