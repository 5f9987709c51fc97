"""Benchmark decontamination by training suffix arrays.

Every shard of the documents (whole texts of some ``SHARD_BYTES``, a longer text alone) gets a suffix
array over its words by prefix doubling, independent of the test items. Every suffix of a test item that
has a whole window is then searched for in it, by binary search on one more word at a time. The range of
suffixes that share the window are the window's places in the shard; the search goes on to the suffix's
longest verbatim match, and neighbouring windows' places give the longest match of each document.

The test items are the stated query set. They are read in blocks of at most ``block_bytes`` of text,
one at a time on the driver, and all blocks are searched in the one array of a shard. If their table
is beyond ``pass_bytes``, the rows flow through several such steps within the same task, each of
which adds its hits to the row's; nothing is joined or shuffled, so rows that share a doc_id, or have none, stay
rows of their own whatever the size of the table.

Edge cases: null texts have no words; items without words never occur; items shorter than a
window are one window; repeated rows are each judged, repeated items count once; an item without
an id has the empty one; very long texts are a shard of their own; an empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, ready
from .encode import blocks as text_blocks
from .text import as_bytes

#: A-Z to a-z; other ASCII but letters and digits separates words; beyond ASCII all are letters.
_TABLE = bytes((i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i > 127 else 32) for i in range(256))
SHARD_BYTES = 4 << 20
STRIDE = 64


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TestBlock:
    """Distinct texts of items as words of one vocabulary, and the suffixes to search for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        ids_of: dict[tuple[bytes, ...], set[str]] = {}
        for i, text in items:
            if ws := words(text):
                ids_of.setdefault(tuple(ws), set()).add("" if i is None else str(i))
        vocab: dict[bytes, int] = defaultdict(count().__next__)
        #: Of each distinct text, the sorted ids of the items that have it.
        self.names = [sorted(own) for own in ids_of.values()]
        self.rank = np.argsort(np.argsort(np.array([n[0] for n in self.names], object), kind="stable"), kind="stable") if self.names else np.empty(0, np.int64)
        sizes = np.array([len(ws) for ws in ids_of], np.int64)
        self.ids = np.array([vocab[w] for ws in ids_of for w in ws] + [0] * STRIDE, np.int64)
        self.vocab = list(vocab)
        ends = np.cumsum(sizes)
        need = np.minimum(sizes, window)
        n = sizes - need + 1
        #: Of each suffix with a whole window: its text, its place in ids and in the text, its window's and its own length.
        self.text = np.repeat(np.arange(len(sizes)), n)
        self.word = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.at = np.repeat(ends - sizes, n) + self.word
        self.need, self.size = np.repeat(need, n), np.repeat(ends, n) - self.at


class Shard:
    """The suffix array of some texts' words. Word ids are those of first occurrence; 0 ends a text.

    The texts' words are taken one text at a time, and ids and places, fewer than 2^31, are of 32 bits.
    """

    def __init__(self, texts: Iterable[list[bytes]]):
        self.vocab: dict[bytes, int] = defaultdict(count(1).__next__)
        get = self.vocab.__getitem__
        parts = [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1  # a text's first word
        n = int(self.sizes.sum() + len(parts))
        self.ids = np.zeros(n + 2 * STRIDE, np.int32)
        for own, at in zip(parts, self.first.tolist()):
            self.ids[at : at + len(own)] = own
        del parts
        self.n = n
        counts = np.bincount(self.ids[:n], minlength=len(self.vocab) + 1)
        #: Suffixes that begin with word w are starts[w] to starts[w + 1] of the array.
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.array = self._sorted(int(self.sizes.max(initial=0))) if n else np.empty(0, np.int32)

    def _sorted(self, longest: int) -> np.ndarray:
        """Prefix doubling: a rank is the first place of all suffixes that agree so far; only tied ones are sorted again."""
        n, bits = self.n, len(self.vocab).bit_length() or 1
        k = 63 // bits  # as many words as fit are sorted at once
        key = np.zeros(n, np.int64)
        for j in range(k):
            key <<= bits
            key |= self.ids[j : n + j]
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
        tied = order[~(new & np.concatenate([new[1:], [True]]))]
        del order, new
        tied = tied[self.ids[tied] > 0]
        while len(tied) and k <= longest:
            old = rank[tied].astype(np.int64)
            after = tied.astype(np.int64) + k
            key = old * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key)
            tied, key, old = tied[order], key[order], old[order]
            place = np.arange(len(tied))
            new_group = np.concatenate([[True], old[1:] != old[:-1]])
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            rank[tied] = old + np.maximum.accumulate(np.where(new_key, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
            alone = new_key & np.concatenate([new_key[1:], [True]])
            tied = tied[~alone]
            k *= 2
        return np.argsort(rank, kind="stable").astype(np.int32)

    def search(self, block: TestBlock) -> tuple[np.ndarray, ...]:
        """Of each suffix of the block: the ranges that share its window (lo, hi) and its longest match (lo, hi, length).

        A suffix without its window in the shard has empty ranges.
        """
        own = np.fromiter((self.vocab.get(w, -1) for w in block.vocab), np.int64, len(block.vocab))
        ids = np.concatenate([own[block.ids[:-STRIDE]], np.full(STRIDE, -1)])
        m = len(block.at)
        lo, hi, depth = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        window_lo, window_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        head = ids[block.at]
        ok = head > 0
        lo[ok], hi[ok], depth[ok] = self.starts[head[ok]], self.starts[head[ok] + 1], 1
        done = lambda q: (depth[q] == block.need[q]) & (window_hi[q] == 0)
        live = np.flatnonzero(ok)
        at_window = live[done(live)]
        window_lo[at_window], window_hi[at_window] = lo[at_window], hi[at_window]
        live = live[depth[live] < block.size[live]]
        stride = np.arange(STRIDE)
        while len(live):
            # As many words as the range's first and last suffix share with the query, all in it share.
            before = np.where(window_hi[live] == 0, block.need[live] - depth[live], STRIDE)
            most = np.minimum(np.minimum(block.size[live] - depth[live], before), STRIDE)
            want = ids[(block.at[live] + depth[live])[:, None] + stride]
            same = np.ones(len(live), bool)[:, None] & (stride < most[:, None])
            for end in (self.array[lo[live]], self.array[hi[live] - 1]):
                same &= self.ids[np.minimum(end + depth[live], self.n)[:, None] + stride] == want
            step = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            depth[live] += step
            stuck = live[step == 0]
            if len(stuck):
                q = ids[block.at[stuck] + depth[stuck]]
                a = self._bound(lo[stuck], hi[stuck], depth[stuck], q)
                b = self._bound(a, hi[stuck], depth[stuck], q + 1)
                found = (b > a) & (q > 0)
                moved = stuck[found]
                lo[moved], hi[moved] = a[found], b[found]
                depth[moved] += 1
                ended = np.zeros(m, bool)
                ended[stuck[~found]] = True
                live = live[~ended[live]]
            at_window = live[done(live)]
            window_lo[at_window], window_hi[at_window] = lo[at_window], hi[at_window]
            live = live[depth[live] < block.size[live]]
        short = window_hi == 0
        lo[short] = hi[short] = depth[short] = 0
        return window_lo, window_hi, lo, hi, depth

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The first of the suffixes lo to hi whose word at depth isn't below word."""
        a, b = lo.copy(), hi.copy()
        while True:
            at = np.flatnonzero(a < b)
            if not len(at):
                return a
            mid = (a[at] + b[at]) >> 1
            less = self.ids[self.array[mid] + depth[at]] < word[at]
            a[at] = np.where(less, mid + 1, a[at])
            b[at] = np.where(less, b[at], mid)

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of many ranges: which range, and where in ids."""
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return which, self.array[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    def whose(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def _longest(shard: Shard, block: TestBlock, q: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, str, int]]:
    """(text, its word, length, item, its word) of each text's longest match, ties by these; q, at: the windows' places."""
    text, word, need = block.text[q], block.word[q], block.need[q]
    order = np.lexsort((at, at - word, text))
    text, word, need, at = text[order], word[order], need[order], at[order]
    # Neighbouring windows of one item at neighbouring places are one match.
    begins = np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1) | (word[1:] != word[:-1] + 1)])
    starts = np.flatnonzero(begins)
    length = need[starts] + np.diff(np.concatenate([starts, [len(at)]])) - 1
    doc, begin, item, item_word = shard.whose(at[starts]), at[starts], text[starts], word[starts]
    order = np.lexsort((item_word, block.rank[item], begin, -length, doc))
    best = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    return [(int(doc[k]), int(begin[k] - shard.first[doc[k]]), int(length[k]), block.names[item[k]][0], int(item_word[k])) for k in best]


class Hits:
    """What a shard's texts have of the test items, over all blocks."""

    def __init__(self, shard: Shard):
        self.shard = shard
        self.cover = np.zeros(shard.n + 1, np.int64)  # +1 where a window begins, -1 behind its end
        self.items: dict[int, set[str]] = {}
        self.best: dict[int, tuple[int, int, str, int]] = {}

    def add(self, block: TestBlock) -> None:
        if not len(block.at):
            return
        lo, hi, *_ = self.shard.search(block)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        which, at = self.shard.places(lo[found], hi[found])
        q = found[which]
        np.add.at(self.cover, at, 1)
        np.subtract.at(self.cover, at + block.need[q], 1)
        n = len(block.names)
        for pair in np.unique(self.shard.whose(at) * n + block.text[q]).tolist():
            self.items.setdefault(pair // n, set()).update(block.names[pair % n])
        for d, a, length, item, b in _longest(self.shard, block, q, at):
            self.best[d] = better(self.best.get(d), (length, a, item, b))

    def spans(self) -> dict[int, list[tuple[int, int]]]:
        """Runs of hit words by text; a text's end is never hit, so none goes beyond it."""
        if not self.items:
            return {}
        hit = np.concatenate([[False], np.cumsum(self.cover) > 0])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        out: dict[int, list[tuple[int, int]]] = {}
        for a, b, d in zip(edges[::2].tolist(), edges[1::2].tolist(), self.shard.whose(edges[::2]).tolist()):
            first = int(self.shard.first[d])
            out.setdefault(d, []).append((a - first, b - first))
        return out


def better(one: tuple[int, int, str, int] | None, two: tuple[int, int, str, int] | None) -> tuple[int, int, str, int] | None:
    """The longer match (length, word, item, its word); of equally long ones that with the lesser rest."""
    if one is None or two is None:
        return one or two
    return min(one, two, key=lambda m: (-m[0], *m[1:]))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(items: DataFrame, window: int, block_bytes: int, pass_bytes: int):
    """Broadcast blocks of the items, in lists of pass_bytes; a block at a time is on the driver."""
    sc = ready(items.sparkSession).sparkContext
    shared, block, held, total = [], [], 0, 0
    for r in items.select("item_id", F.encode("text", "UTF-8").alias("text")).where("text is not null").distinct().toLocalIterator():
        size = len(r["text"]) + 16
        if block and held + size > block_bytes:
            shared.append(sc.broadcast(TestBlock(block, window)))  # bounded by block_bytes
            block, held = [], 0
        if total and total + size > pass_bytes:
            if block:
                shared.append(sc.broadcast(TestBlock(block, window)))
            yield shared
            shared, block, held, total = [], [], 0, 0
        block.append((r["item_id"], bytes(r["text"])))
        held, total = held + size, total + size
    if block or not total:
        shared.append(sc.broadcast(TestBlock(block, window)))
    yield shared


def _each(shared: list):
    """The blocks' values; if there are several, only one is held."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            b.__dict__.pop("_value", None)


def _hits(texts: pa.Array, shared: list) -> Hits:
    hits = Hits(Shard(map(words, as_bytes(texts))))
    for block in _each(shared):
        hits.add(block)
    return hits


_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_MATCH = pa.struct([("length", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])
_STATE = "n_words long, spans array<struct<a:int,b:int>>, items array<string>, best struct<length:long,at:long,item:string,item_at:long>"


def judge(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the longest match and the hit spans of each row.

    longest: words of the longest verbatim match, 0 without one; longest_at, longest_item and longest_item_at: where it
    begins, in words from 0, and in which item (null without one).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for shared in _passes(items, window, block_bytes, pass_bytes):
        first = "spans" not in rows.columns

        def run(batches, shared=shared, first=first):
            for batch in batches:
                for part in text_blocks(batch, "text", SHARD_BYTES):
                    hits = _hits(part.column("text"), shared)
                    own, n, sizes = hits.spans(), range(part.num_rows), hits.shard.sizes
                    spans, found, best = [own.get(i, []) for i in n], [hits.items.get(i, set()) for i in n], [hits.best.get(i) for i in n]
                    del hits  # else it is there while the next shard is built
                    if not first:
                        spans = [merge(x + [(s["a"], s["b"]) for s in y]) for x, y in zip(spans, part.column("spans").to_pylist())]
                        found = [x.union(y) for x, y in zip(found, part.column("items").to_pylist())]
                        best = [better(x, y and tuple(y.values())) for x, y in zip(best, part.column("best").to_pylist())]
                    names = ("length", "at", "item", "item_at")
                    state = [pa.array(sizes, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], _SPAN), pa.array(map(sorted, found), pa.list_(pa.string())), pa.array([m and dict(zip(names, m)) for m in best], _MATCH)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *state], names=["doc_id", "text", "n_words", "spans", "items", "best"])

        rows = rows.mapInArrow(run, f"doc_id {kind}, text string, {_STATE}")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]))
    longest = [F.coalesce("best.length", F.lit(0).cast("long")).alias("longest"), F.col("best.at").alias("longest_at"), F.col("best.item").alias("longest_item"), F.col("best.item_at").alias("longest_item_at")]
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *longest, "spans")


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """Each test suffix's longest verbatim matches over all shards: doc_id, doc_word, length, item_id, item_word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = None
    for shared in _passes(items, window, block_bytes, pass_bytes):

        def run(batches, shared=shared):
            for batch in batches:
                for part in text_blocks(batch, "text", SHARD_BYTES):
                    shard = Shard(map(words, as_bytes(part.column("text"))))
                    for block in _each(shared):
                        _, _, lo, hi, length = shard.search(block)
                        which, at = shard.places(lo, hi)
                        doc = shard.whose(at)
                        names = [block.names[i] for i in block.text[which]]
                        each = np.repeat(np.arange(len(at)), [len(x) for x in names]) if names else np.empty(0, np.int64)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[each])), pa.array((at - shard.first[doc])[each]), pa.array(length[which][each]), pa.array([x for own in names for x in own], pa.string()), pa.array(block.word[which][each])], names=["doc_id", "doc_word", "length", "item_id", "item_word"])

        one = rows.mapInArrow(run, f"doc_id {kind}, doc_word long, length long, item_id string, item_word long")
        out = one if out is None else out.unionByName(one)
    most = Window.partitionBy("item_id", "item_word")
    return out.withColumn("most", F.max("length").over(most)).where("length = most").drop("most")


def remove(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = 4 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """The documents that no window of an item occurs in, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for shared in _passes(items, window, block_bytes, pass_bytes):

        def run(batches, shared=shared):
            for batch in batches:
                for part in text_blocks(batch, at, SHARD_BYTES):
                    items_of = _hits(part.column(at), shared).items  # the shard is gone before the next one is built
                    yield part.filter(pa.array([i not in items_of for i in range(part.num_rows)], pa.bool_()))

        docs = map_rows(docs, run)
    return docs
