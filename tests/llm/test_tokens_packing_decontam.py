"""Operators 4, 7 and 10 against direct computations on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from colonnade.llm import decontam, packing, tokenio

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word number " * 30_000
TEXTS = [None, "", " ", "a  b", "x\n\ny", " lead", "trail ", "tab\tx y", "don't, it's. ok", "<|endoftext|> a.b|", "a  b", "\n", "é,è. ñ!!! a-b (c) 12,3.4", "a\x01b", "日本 語, 。 x", "a 's b, 're", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "x") for i, t in enumerate(TEXTS)] + [(3, "a  b", "clash", "x"), (3, "other", "clash", None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string, part string").repartition(3)


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_round_trip(docs, encoding):
    got = sorted(map(tuple, tokenio.round_trip(docs, PATH, 2, encoding=encoding).collect()), key=lambda r: r[1])
    rows = sorted(docs.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    at, want = 0, []
    for d, t, _ in rows:
        ids = ids_of(t, 2)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_rows_without_ids_are_ranged(spark, tmp_path):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = tokenio.write_tokens(docs, f"file://{tmp_path}/t", PATH, 2, partitions=4)
    assert spark.read.parquet(path).groupBy("part").count().where("count > 20").count() >= 3
    got = tokenio.read_metadata(spark, path).orderBy("start").collect()
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(400)]


def test_metadata_read_leaves_tokens_alone(spark, docs, tmp_path):
    path = tokenio.write_tokens(docs, f"file://{tmp_path}/t", PATH, 2)
    meta = tokenio.read_metadata(spark, path)
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()
    assert meta.count() == docs.count()
    one = tokenio.read_tokens(spark, path).where("doc_id = 8").collect()[0]
    assert list(one["tokens"]) == ids_of(TEXTS[8], 2)


def test_token_empty_table(spark, docs):
    assert tokenio.round_trip(docs.limit(0), PATH, 2).count() == 0


def check_packing(rows, docs, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = ids_of(t, 0)
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want, key=str)
    return len(by)


def test_packing(docs):
    rows = packing.pack(docs, PATH, 0, 2048).collect()
    check_packing(rows, docs, 2048)


def test_packing_many_shards_is_near_the_bound(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat "), (F.col("id") * 37 % 23 + 1).cast("int")).alias("text"))
    rows = packing.pack(docs, PATH, 0, 64, shard_pieces=100, population=4, generations=6).collect()
    n = check_packing(rows, docs, 64)
    assert n <= 1.06 * -(-sum(r["length"] for r in rows) // 64)


def test_packing_empty_table(docs):
    assert packing.pack(docs.limit(0), PATH, 0).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    island = packing.Island(rng.integers(1, 60, 200).tolist(), 100, 1, 4)
    island.seed()
    for _ in range(20):
        bins = island.cross(island.members[0][1], island.members[-1][1])
        assert sorted(i for b in bins for i in b) == list(range(200))
        assert all(sum(island.sizes[i] for i in b) <= 100 for b in bins)
        island.add(bins)


JUDGED = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def brute(docs, items, window):
    table = [(str(i), re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in items]
    out = {}
    for d, t in docs:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hit, found = set(), set()
        for i, tw in table:
            n = min(window, len(tw))
            for k in range(len(tw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == tw[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        out[d] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, block_bytes):
    rng = np.random.default_rng(3)
    vocab = ["alpha", "Beta", "gämma", "d3", "e", "für"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(n)) for i, n in enumerate([12, 15, 2, 1, 7, 30, 11])] + [(10, None), (11, "..."), (12, "zzz yyy xxx www vvv"), (0, "repeat of item one by another text that is long enough")]
    docs = [(i, ", ".join([say(int(rng.integers(0, 60))), items[i % 7][1].upper() if i % 3 else "", say(9)])) for i in range(40)] + [(40, None), (41, ""), (42, "zzz! YYY xxx www vvv"), (43, "zzz yyy xxx www"), (44, items[5][1] + "." + items[5][1])]
    got = decontam.judge(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 10, block_bytes=block_bytes).select(*JUDGED).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(docs, items, 10)
    kept = decontam.remove(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert kept.columns == ["doc_id", "text", "spans"]
    assert {r[0] for r in kept.collect()} == {r[0] for r in got if not r["contaminated"]}


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination_judges_every_row(spark, block_bytes):
    """Rows that share a doc_id, or have none, and equal rows, with one block of items and with several."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(14))) for i in range(8)]
    a, b, c = (f"one {items[i][1]} two {items[(i + 3) % 8][1]}" for i in (0, 1, 5))
    texts = [(1, a), (1, b), (1, a), (1, "no hit at all"), (None, a), (None, c), (None, c), (None, None), (None, ""), (2, ""), (3, " ".join(t for _, t in items))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = decontam.judge(docs, spark.createDataFrame(items, "item_id long, text string"), 10, block_bytes=block_bytes).select(*JUDGED).collect()
    want = [(d, *brute([(d, t)], items, 10)[d]) for d, t in texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_longest_matches_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"W{i}" for i in range(3, 20)) + " z"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = decontam.matches(docs, items).collect()
    assert (1, 2, 17, "7", 3) in {tuple(r) for r in found}
    assert decontam.judge(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontam.judge(docs.limit(0), items).count() == 0
