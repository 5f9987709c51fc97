"""Suffix arrays, longest matches and row-by-row verdicts against brute force."""

import numpy as np
import pytest

from colonnade.llm import decontam as d

LIMITS = [{}, {"block_bytes": 40}, {"block_bytes": 40, "pass_bytes": 150}]


def say(rng, n):
    return " ".join(rng.choice(["a", "b", "c", "da", "e"], n))


def longest(text, items, window):
    """(length, word, item, its word) of the longest run of equal words that holds a window, ties by the rest."""
    ws, best = d.words(text.encode()), []
    for i, t in items:
        tw = d.words((t or "").encode())
        n = min(window, len(tw))
        for a in range(len(ws)):
            for b in range(len(tw)):
                k = 0
                while a + k < len(ws) and b + k < len(tw) and ws[a + k] == tw[b + k]:
                    k += 1
                if n and k >= n and b + n <= len(tw):
                    best.append((-k, a, "" if i is None else str(i), b))
    return (-min(best)[0], *min(best)[1:]) if best else (0, None, None, None)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    texts = [d.words(say(rng, int(rng.integers(0, 60))).encode()) for _ in range(30)] + [[b"x"] * 300, [b"x"] * 300, []]
    s = d.Shard(texts)
    assert sorted(s.array.tolist()) == list(range(s.n))
    suffix = lambda p: s.ids[p : p + int(np.argmin(s.ids[p : s.n] != 0))].tolist()
    keys = [suffix(p) for p in s.array.tolist()]
    assert keys == sorted(keys)
    assert d.Shard([]).n == 0 and d.Shard([[]]).array.tolist() == [0]


@pytest.mark.parametrize("limits", LIMITS)
def test_every_row_is_judged_alike(spark, limits):
    rng = np.random.default_rng(8)
    items = [(k, say(rng, n)) for k, n in enumerate([12, 14, 3, 1, 9, 25, 11])] + [(1, say(rng, 13)), (None, "null id " + say(rng, 12)), (9, None), (10, "  "), (4, "zz " + say(rng, 4))]
    texts = [say(rng, int(rng.integers(0, 40))) + " " + (items[k % 7][1] or "") + " " + say(rng, 3) for k in range(12)]
    rows = [(1, texts[0], "x"), (1, texts[0], "x"), (1, texts[1], "y"), (None, texts[2], "z"), (None, texts[2], "z"), (None, None, "z"), (7, "", "z"), *((20 + k, t, "w") for k, t in enumerate(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.judge(docs, bench, 6, **limits).select("doc_id", "n_words", "longest", "longest_at", "longest_item", "longest_item_at").collect()
    want = [(i, len(d.words((t or "").encode())), *longest(t or "", items, 6)) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = d.remove(docs, bench, 6, **limits)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(((i, t) for (i, t, _), w in zip(rows, want) if not w[2]), key=str)


@pytest.mark.parametrize("limits", LIMITS)
def test_longest_matches_over_all_shards(spark, limits):
    item = " ".join(f"w{k}" for k in range(200))
    part = lambda a, b: " ".join(f"W{k}" for k in range(a, b))
    docs = spark.createDataFrame([(1, "x y " + part(3, 20) + " z"), (2, part(2, 190)), (3, "z " + part(2, 190) + " " + part(2, 190)), (4, "none")], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(5, item), (6, "other words"), (7, "more of other words that do not occur here in any text")], "item_id long, text string")
    got = {tuple(r) for r in d.matches(docs, bench, **limits).collect()}
    want = {(doc, at + k - 2, 190 - k, "5", k) for k in range(2, 181) for doc, at in ((2, 0), (3, 1), (3, 189))}
    assert got == want


def test_very_long_text_and_clashing_names(spark):
    long = "word number " * 150_000 + "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, long, 3), (2, "word", 4)], "doc_id long, text string, best int")
    bench = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    got = {r["doc_id"]: r for r in d.judge(docs, bench).collect()}
    assert got[1]["longest"] == got[1]["n_hit"] == 11 and got[1]["longest_at"] == 300_000 and not got[2]["contaminated"]
    assert [r["best"] for r in d.remove(docs, bench).collect()] == [4]
