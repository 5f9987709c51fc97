"""Packing documents into training sequences by a grouping genetic algorithm on islands.

1. Each document is encoded and cut into pieces of at most ``capacity`` tokens (only the first
   piece of a longer one is shorter); pieces of full length are sequences of their own.
2. The rest is dealt by a hash of their place to shards of about ``shard_pieces`` pieces, so a
   task's memory is bounded whatever the corpus holds; only lengths are shuffled.
3. Each shard is evolved on ``islands`` islands, every one a group of its own. An individual is a
   list of sequences; the first ones are made by best fit and by filling sequences one by one with the one or two pieces that
   suit them. Crossover injects the fullest sequences of both parents whole,
   leaving out those that would hold a piece twice. Displaced pieces replace shorter ones where a sequence gets
   fuller, and the rest is best-fitted, longest first. After each epoch an island's elite also goes to the next island.
4. The best island's packing stands. Pieces of sequences filled below ``refill`` are dealt anew
   and packed once more, which closes the gaps at the shards' ends.

Edge cases: null and empty texts hold the end id alone and are packed like any other; rows that
share a doc_id are each packed; null doc_ids are kept; an empty table gives no row.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import encode
from .common import materialize, ready, scratch


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = encode.encoder(tokenizer)
        for batch in batches:
            for block in encode.blocks(batch, "text"):
                ids, offsets = coder.encode(block.column("text"))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                of, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    cut = a + ((b - a) % capacity or min(capacity, b - a))
                    for k, (x, y) in enumerate([(a, cut), *((x, x + capacity) for x in range(cut, b, capacity))]):
                        of.append(i), piece.append(k), start.append(x - a), length.append(y - x), crc.append(zlib.crc32(ids[x:y]))
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts items, longest first, each where the least room is left; opens a bin where none fits."""
    by_room: dict[int, list[int]] = {}
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
    order = sorted(by_room)
    for item in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        at = bisect.bisect_left(order, size)
        if at < len(order):
            r = order[at]
            b = by_room[r].pop()
            if not by_room[r]:
                del by_room[r], order[at]
            bins[b].append(item)
        else:
            b, r = len(bins), capacity
            bins.append([item])
            room.append(r)
        room[b] = r - size
        if room[b]:
            if room[b] in by_room:
                by_room[room[b]].append(b)
            else:
                by_room[room[b]] = [b]
                bisect.insort(order, room[b])


class Loose:
    """Pieces that are in no bin, by size; finds what fits a room best."""

    def __init__(self, sizes: list[int], items: list[int], capacity: int):
        self.sizes, self.held = sizes, [[] for _ in range(capacity + 1)]
        for i in items:
            self.held[sizes[i]].append(i)
        self.n = len(items)
        self.counts = np.array([len(h) for h in self.held])
        self.fresh()

    def fresh(self) -> None:
        #: The greatest size up to each size that there is a piece of, 0 if none.
        self.upto = np.maximum.accumulate(np.where(self.counts > 0, np.arange(len(self.counts)), 0))

    def take(self, size: int) -> int:
        self.n -= 1
        self.counts[size] -= 1
        if not self.counts[size]:
            self.fresh()
        return self.held[size].pop()

    def put(self, item: int) -> None:
        size = self.sizes[item]
        self.n += 1
        self.held[size].append(item)
        self.counts[size] += 1
        if self.counts[size] == 1:
            self.fresh()

    def one(self, room: int) -> int:
        """The greatest size that fits, 0 if none."""
        return int(self.upto[room])

    def two(self, room: int) -> tuple[int, int]:
        """The two sizes of the greatest sum that fits, zeros if none."""
        first = np.arange(1, room // 2 + 1)
        second = self.upto[room - first]
        ok = (self.counts[first] > 0) & (second >= first) & ((second > first) | (self.counts[first] > 1))
        if not ok.any():
            return 0, 0
        k = int(np.argmax(np.where(ok, first + second, 0)))
        return int(first[k]), int(second[k])

    def fill(self, bin_: list[int], room: int) -> int:
        """Adds the one or two pieces that fill the room best, as long as any fits; gives the room that is left."""
        while room and (one := self.one(room)):
            if one < room and sum(pair := self.two(room)) > one:
                bin_ += [self.take(pair[0]), self.take(pair[1])]
                room -= sum(pair)
            else:
                bin_.append(self.take(one))
                room -= one
        return room


class Island:
    """A population of packings of one shard, deterministic in its seed."""

    def __init__(self, sizes: list[int], capacity: int, seed: int, population: int):
        self.sizes, self.capacity, self.population = sizes, capacity, population
        self.rng = np.random.default_rng(seed)
        self.least = -(-sum(sizes) // capacity)
        self.members: list[tuple[float, list[list[int]]]] = []

    def load(self, b: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, b))

    def add(self, bins: list[list[int]]) -> None:
        """Keeps the best: few sequences first, then those whose fill is the most uneven; of equal ones one stays."""
        fills = np.array([self.load(b) for b in bins]) / self.capacity
        worth = len(bins) - float(np.mean(fills**2)) if bins else 0.0
        if any(abs(worth - w) < 1e-12 for w, _ in self.members):
            return
        self.members.append((worth, bins))
        self.members.sort(key=lambda m: m[0])
        del self.members[self.population :]

    def seed(self) -> None:
        """Best fit in falling order; bins filled one by one with what suits their room, begun by the longest piece left, or by any."""
        every = list(range(len(self.sizes)))
        bins: list[list[int]] = []
        best_fit(self.sizes, every, bins, [], self.capacity)
        self.add(bins)
        for k in range(self.population - 1 if not self.done() else 1):
            loose, bins = Loose(self.sizes, every, self.capacity), []
            while loose.n:
                first = loose.one(self.capacity)
                if k % 3 == 2 or k and self.rng.random() < 0.2:
                    first = int(np.searchsorted(np.cumsum(loose.counts), self.rng.integers(loose.n), side="right"))
                b = [loose.take(first)]
                loose.fill(b, self.capacity - first)
                bins.append(b)
            self.add(bins)

    def done(self) -> bool:
        return bool(self.members) and len(self.members[0][1]) <= self.least

    def cross(self, mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        """The fuller of both parents' sequences first, each whole and only while no piece of it is in already; then what is displaced."""
        both = [*mother, *father]
        loads = np.array([self.load(b) for b in both]) + self.rng.random(len(both))
        least = np.quantile(loads, self.rng.uniform(0.05, 0.5))
        inside: set[int] = set()
        bins = []
        for k in np.argsort(-loads, kind="stable").tolist():
            if loads[k] < least:
                break
            if inside.isdisjoint(both[k]):
                inside.update(both[k])
                bins.append(list(both[k]))
        displaced = [i for i in range(len(self.sizes)) if i not in inside]
        return self.place(bins, displaced)

    def place(self, bins: list[list[int]], displaced: list[int]) -> list[list[int]]:
        """Displaced pieces replace shorter ones, alone or in twos, where that fills a sequence better; the rest is best-fitted, or filled bin by bin."""
        loose = Loose(self.sizes, displaced, self.capacity)
        for b in bins:
            room = self.capacity - self.load(b)
            if not room or not loose.n:
                continue
            room = loose.fill(b, room)
            for at in self.rng.permutation(len(b)).tolist():
                if not room:
                    break
                own = self.sizes[b[at]]
                pair = loose.two(own + room)
                new = loose.one(own + room)
                if max(new, sum(pair)) <= own:
                    continue
                out = b[at]
                if sum(pair) > new:
                    b[at] = loose.take(pair[0])
                    b.append(loose.take(pair[1]))
                    room -= sum(pair) - own
                else:
                    b[at] = loose.take(new)
                    room -= new - own
                loose.put(out)
        left = [i for h in loose.held for i in h]
        one = [list(b) for b in bins]
        best_fit(self.sizes, left, one, [self.capacity - self.load(b) for b in one], self.capacity)
        two = bins
        while loose.n:
            first = loose.one(self.capacity)
            two.append([loose.take(first)])
            loose.fill(two[-1], self.capacity - first)
        return one if len(one) <= len(two) else two

    def evolve(self, generations: int) -> None:
        """At least one generation; no more where the pieces' sum allows no fewer sequences."""
        for k in range(generations):
            if k and self.done() or not self.members or not self.members[0][1]:
                return
            a, b = self.rng.choice(len(self.members), 2, replace=False) if len(self.members) > 1 else (0, 0)
            child = self.cross(self.members[a][1], self.members[b][1])
            self.add(child)


def _assignment(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    cuts = np.flatnonzero(np.diff(assigned[order])) + 1
    return [b.tolist() for b in np.split(order, cuts)]


_STATE = "shard long, island int, origin int, uid long, length long, bin long, n_bins long"


def _epoch(capacity: int, population: int, generations: int, first: bool):
    """Runs one island for some generations; its rows are its own elite and those that came in."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        own = rows[rows["origin"] == rows["origin"].min()].sort_values("uid")
        sizes = own["length"].tolist()
        here = Island(sizes, capacity, (shard * 1_000_003 + island) * 2 + first, population)
        if not first:
            for _, elite in rows.sort_values("uid").groupby("origin"):
                here.add(_bins(elite["bin"].to_numpy()))
        if first:
            here.seed()
        if first or not here.done():
            here.evolve(generations)
        bins = here.members[0][1]
        return pd.DataFrame({"shard": shard, "island": island, "origin": island, "uid": own["uid"].to_numpy(), "length": sizes, "bin": _assignment(bins, len(sizes)), "n_bins": len(bins)})

    return run


def _pack_shards(items: DataFrame, n: int, capacity: int, shard_pieces: int, islands: int, epochs: int, population: int, generations: int, salt: int, name: str) -> DataFrame:
    """uid, length, shard and bin of each item."""
    shards = max(1, -(-n // shard_pieces))
    state = items.select(F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("origin"), "uid", "length", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n_bins"))
    for epoch in range(epochs):
        if epoch:
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
            state = state.unionByName(moved) if islands > 1 else state
        state = materialize(state.groupBy("shard", "island").applyInPandas(_epoch(capacity, population, generations, epoch == 0), _STATE), f"{name}-{epoch}")
    best = state.groupBy("shard").agg(F.min(F.struct("n_bins", "island")).alias("best")).select("shard", F.col("best.island").alias("island"))
    return state.join(best, ["shard", "island"]).select("uid", "length", "shard", "bin")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = 4096, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 12, refill: float = 0.97) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    with scratch(ready(docs.sparkSession)) as keep:
        cut = pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
        return keep(_place(cut, capacity, (shard_pieces, islands, epochs, population, generations), refill), "packing")


def _place(cut: DataFrame, capacity: int, how: tuple, refill: float) -> DataFrame:
    cut = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    loose = cut.where(~whole).select("uid", "length")
    n = loose.count()
    args = (capacity, *how)
    one = _pack_shards(loose, n, *args, 0, "pack").withColumn("level", F.lit(0))
    one = materialize(one, "packed")
    fill = one.groupBy("shard", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < refill * capacity).select("shard", "bin")
    poor = materialize(one.join(fill, ["shard", "bin"]).select("uid", "length"), "poor")
    two = _pack_shards(poor, poor.count(), *args, 1, "refill").withColumn("level", F.lit(1))
    kept = one.join(fill, ["shard", "bin"], "left_anti").select("uid", "length", "shard", "bin", "level").unionByName(two.select("uid", "length", "shard", "bin", "level"))

    def lay(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "uid"])
        offset = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return pd.DataFrame({"uid": rows["uid"], "sequence_id": (int(key[0]) << 60) + (int(key[1]) << 24) + rows["bin"], "offset": offset})

    placed = kept.groupBy("level", "shard").applyInPandas(lay, "uid long, sequence_id long, offset long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = cut.where(whole).select("*", (F.col("uid") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.select(columns).unionByName(cut.where(~whole).join(placed, "uid").select(columns))
