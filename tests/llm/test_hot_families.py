"""Large families of texts that are alike, but not enough; bits and filters against direct computations."""

import time

import numpy as np
from pyspark.sql import functions as F

from colonnade.llm import minhash


def test_a_family_of_5000_at_065_has_no_links(spark):
    """Pages of one form: each shares 158 of its 200 shingles with every other, and one pair is alike."""
    form = " ".join(f"form{k}" for k in range(162))
    own = "array_join(transform(sequence(0, 41), k -> concat('own', id, 'x', k)), ' ')"
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr(f"concat('{form} ', {own})").alias("text"))
    twin = docs.where("doc_id = 77").select(F.lit(9000).cast("long").alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    began = time.time()
    got = minhash.near_duplicates(docs.unionByName(twin))
    assert {tuple(r) for r in got.where("not kept").collect()} == {(9000, 201, 77, False)}
    assert got.where("kept").count() == 5000
    assert time.time() - began < 120


def test_bit_rows_give_exact_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, int(rng.integers(0, 200))).astype(np.uint64)) for _ in range(40)]
    rows = minhash.bit_rows(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert np.bitwise_count(rows[i] & rows[j]).sum() == len(np.intersect1d(sets[i], sets[j]))
    assert minhash.bit_rows(sets, 100) is None


def test_links_without_bit_rows(spark, monkeypatch):
    docs = [(k, " ".join(f"w{i}" for i in range(k % 3 * 1000, k % 3 * 1000 + 100 - k // 3))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    s = [np.arange(k % 3 * 1000, k % 3 * 1000 + 100 - k // 3).astype(np.uint64) for k in range(12)]
    a, b = minhash._permutations(120)
    sigs = minhash.unpacked([minhash.signature(minhash.minima(x, a, b)) for x in s])
    links = []
    for rows in (minhash.bit_rows, lambda sets: None):
        monkeypatch.setattr(minhash, "bit_rows", rows)
        root = np.arange(12)
        minhash._links([bytes([k]) for k in range(12)], s, sigs, root, np.arange(12), None, 85, 0.68, 120)
        links.append([root[i] == root[j] for i in range(12) for j in range(12)])
    assert links[0] == links[1]
    assert {r[2] for r in want} == {0, 1, 2}


def test_filter_keeps_what_is_among_the_ids(spark):
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = spark.range(0, 3000, 50).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"] for r in minhash._may_be_among(texts, ids).collect()}
    assert got >= set(range(0, 3000, 50)) and len(got) < 70
    few = minhash._may_be_among(texts, ids, words=1)
    assert {r["doc_id"] for r in few.collect()} >= set(range(0, 3000, 50))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_only_the_results_table_is_left(spark):
    from colonnade import store

    before = len(store._TABLES)
    assert minhash.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).count() == 2
    assert len(store._TABLES) == before + 1


def test_deduplicate_shuffles_no_text_of_kept_rows(spark):
    rows = [(k, f"text {k} has words of its own {k}", "x") for k in range(200)] + [(300 + k, f"text {k} has words of its own {k}", "y") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, filter_word string")
    got = minhash.deduplicate(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == set(range(200))
    sure, maybe = minhash._split(docs, "doc_id", spark.createDataFrame([(3,), (None,)], "doc_id long"))
    assert {r["doc_id"] for r in maybe.collect()} >= {3} and sure.count() + maybe.count() == 205 and sure.count() > 195
    assert maybe.where("doc_id is null").count() == 0
    nulls = docs.unionByName(spark.createDataFrame([(None, "t", "z")], docs.schema))
    assert minhash._split(nulls, "doc_id", spark.createDataFrame([(None,)], "doc_id long"))[1].where("doc_id is null").count() == 1
