"""The pipeline's stages: what each keeps, and the whole against the stages' own brute-force pieces."""

import os

import pytest

pytest.importorskip("tokenizers")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_in_order(spark):
    import corpus_pipeline as p
    from colonnade.llm import decontam, rules
    from colonnade.llm.queries import table
    from test_dedup_quality_text import brute_components
    from test_tokens_packing_decontam import brute, check_packing

    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = p.classify(spark, docs, SF)
    assert kept.columns == columns
    model = rules.train(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in rules.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    alone = p.near_dedup(spark, kept, SF)
    assert alone.columns == columns
    want = {r[0] for r in brute_components([(r["doc_id"], r["text"]) for r in kept.collect()], 80) if r[3]}
    assert {r["doc_id"] for r in alone.collect()} == want
    alone = spark.createDataFrame(alone.collect(), docs.schema)
    clean = p.decontaminate(spark, alone, SF)
    hit = brute([(r["doc_id"], r["text"]) for r in alone.collect()], [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()], 10)
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {d for d, v in hit.items() if not v[-1]}
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    safe = p.pseudonymize(spark, clean, SF)
    assert safe.columns == columns and safe.count() == clean.count()
    safe = spark.createDataFrame(safe.collect(), docs.schema)
    rows = p.pack(spark, safe, SF).collect()
    n = check_packing(rows, safe, 2048)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // 2048) + 1
    whole = p.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, rows))
    assert decontam  # the stages' operators stand alone, too


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
