"""The genetic algorithm against best fit in falling order, on fixed hard instances; odd tables."""

import numpy as np
import pytest

pytest.importorskip("tokenizers")
import public_tokenizers
from test_tokens_packing_decontam import check_packing

from colonnade.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("low, high, seed", [(410, 1100, 3), (600, 1000, 4), (300, 800, 5), (410, 1100, 6), (600, 1000, 7), (300, 800, 8)])
def test_fewer_sequences_than_best_fit(low, high, seed):
    sizes = np.random.default_rng(seed).integers(low, high + 1, 2000).tolist()
    plain: list[list[int]] = []
    packing.best_fit(sizes, list(range(2000)), plain, [], 2048)
    island = packing.Island(sizes, 2048, 1, 6)
    island.seed()
    seeded = len(island.members[0][1])
    island.evolve(12)
    bins = island.members[0][1]
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(island.load(b) <= 2048 for b in bins)
    assert island.least <= len(bins) < seeded < len(plain)


def test_two_is_the_best_pair():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 30, int(rng.integers(1, 12))).tolist()
        loose = packing.Loose(sizes, list(range(len(sizes))), 40)
        room = int(rng.integers(1, 40))
        best = max((a + b for i, a in enumerate(sizes) for b in sizes[:i] if a + b <= room), default=0)
        assert sum(loose.two(room)) == best
        assert loose.one(room) == max((a for a in sizes if a <= room), default=0)


def test_islands_agree_in_spark(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, " the" * int(rng.integers(12, 33)), 7, 8, "x", 9) for k in range(400)], "doc_id long, text string, piece int, start int, uid string, offset int")
    rows = packing.pack(docs, PATH, 0, 64, shard_pieces=300).collect()
    n = check_packing(rows, docs, 64)
    sizes = [r["length"] for r in rows]
    plain: list[list[int]] = []
    packing.best_fit(sizes, list(range(400)), plain, [], 64)
    assert n <= len(plain)


def test_no_pieces():
    island = packing.Island([], 10, 1, 3)
    island.seed()
    island.evolve(3)
    assert island.members[0][1] == []
