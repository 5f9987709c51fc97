"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each text's set of hashed word shingles gives a digest and, by ``bands * rows`` permutations,
   minima. Whole minima of a band make its bucket; the signature keeps only the low ``bits`` bits
   of each minimum, packed plane by plane into 64-bit words. Texts of one digest are represented by one node.
2. Buckets are counted and joined as (bucket, node) alone; signatures are fetched for nodes that share one.
   In a bucket, pairs of nodes are compared by signature: planes are XORed and ORed, set bits counted, and the share
   of equal minima is corrected for the 2**-bits of them that agree by chance. Pairs whose sizes
   allow the similarity and whose estimate is at most ``slack`` below it are candidates; a bucket
   emits a spanning forest of them, never all pairs. A bucket too large for that is linked as it
   is, by a star: what belongs together stays together, and the next steps sort it out.
3. Candidates' connected components (alternating large and small stars) are clusters. The texts of
   their members alone are read again: a Bloom filter of their ids, a table of at most ``FILTER_WORDS`` words,
   picks them in the scan, so no other text is shuffled. Each cluster's sets are compared exactly, as rows of bits over
   the shingles that at least two of them have. Pairs are skipped
   if already connected or if sizes or signatures rule them out. A cluster with more shingles than
   ``cluster_shingles`` is cut into blocks: nodes are compared within blocks, then the
   representatives of the components found, then what isn't in the largest component with all else.
4. The links' components are the result.

Two texts at the threshold share none of the bands with a probability of some 1e-6; 1e-6 is also
about what the estimate's slack of five standard deviations loses. All else is exact. That holds for
24 bands at near_duplicates' 0.85 and for 36 at deduplicate's 0.80 (0.6e-6).

Edge cases: null, empty and blank texts have no shingles, are linked with nothing and are kept; a
text of fewer words than a shingle is one shingle of all of them; repeated rows share a component,
and rows that share a doc_id are each judged by their text; null doc_ids are kept only where
their whole component has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField

from .common import free_name, map_rows, materialize, ready, scratch
from .components import connected_components
from .text import as_bytes, shingles

BANDS, ROWS, BITS = 24, 5, 4
#: 64-bit words of the Bloom filter of the ids whose texts are read again: what of it is broadcast is at most some 32 MB.
FILTER_WORDS = 1 << 20
#: Bytes of a cluster's rows of bits; sets that would need more are compared one by one.
BIT_ROWS_BYTES = 64 << 20
#: What deduplicate takes for near, in percent, and the bands for it.
STAGE_PERCENT, STAGE_BANDS = 80, 36


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of 64-bit hashes."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[at : at + 1024, None] * a[None, :] + b[None, :]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, (y ^ (y >> np.uint32(13))).min(axis=0), out=out)
    return out


def signature(least: np.ndarray, bits: int = BITS) -> bytes:
    """The low bits of each minimum: plane by plane, each in whole 64-bit words."""
    out = np.zeros((bits, -(-len(least) // 64) * 8), np.uint8)
    for j in range(bits):
        plane = np.packbits((least >> np.uint32(j)).astype(np.uint8) & 1)
        out[j, : len(plane)] = plane
    return out.tobytes()


def unpacked(sigs: list[bytes], bits: int = BITS) -> np.ndarray:
    """Signatures as words: one row each, by plane."""
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), bits, -1)


def estimates(one: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Similarities of a signature to others by the bits that differ, corrected for chance collisions."""
    differ = np.bitwise_count(np.bitwise_or.reduce(many ^ one, axis=1)).sum(axis=1, dtype=np.int64)
    chance = 2.0 ** -one.shape[0]
    return ((n - differ) / n - chance) / (1 - chance)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(docs: DataFrame, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    a, b = _permutations(bands * rows)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out = [[] for _ in range(4)]
                for text in as_bytes(part.column("text")):
                    s = shingles(text.lower().split(), width)
                    least = minima(s, a, b) if len(s) else None
                    out[0].append(len(s))
                    out[1].append(digest(s) if len(s) else None)
                    out[2].append(signature(least, bits) if len(s) else None)
                    out[3].append([xxhash.xxh3_64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), k) - 2**63 for k in range(bands)] if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "sig", "buckets"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, sig binary, buckets array<long>")


def _unite(root: np.ndarray, i: int, near: np.ndarray) -> list[int]:
    """One of near for each component that isn't i's; all become i's."""
    roots, first = np.unique(root[near], return_index=True)
    found = near[first[roots != root[i]]].tolist()
    for j in found:
        root[root == root[j]] = root[i]
    return found


def _forest(n_perms: int, bits: int, percent: int, slack: float):
    """Spanning forests of the candidate graphs of many small buckets, given sorted by bucket."""
    floor = percent / 100 - slack

    def one(nodes: list[bytes], sizes: np.ndarray, sigs: np.ndarray, out: list) -> None:
        root = np.arange(len(nodes))
        for i in range(len(nodes) - 1):
            rest = np.arange(i + 1, len(nodes))
            rest = rest[(root[rest] != root[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
            if len(rest):
                out.extend((nodes[i], nodes[j]) for j in _unite(root, i, rest[estimates(sigs[i], sigs[rest], n_perms) >= floor]))

    def run(batches):
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for members in batch.column("members").to_pylist():
                one([m["node"] for m in members], np.array([m["n_shingles"] for m in members]), unpacked([m["sig"] for m in members], bits), out)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return run


def _candidates(nodes: DataFrame, n_perms: int, bits: int, percent: int, slack: float, bucket_nodes: int) -> DataFrame:
    """Edges a, b whose components hold every candidate pair."""
    each = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    shared = materialize(each.join(sizes, "bucket"), "buckets")
    small = shared.where(F.col("n") <= bucket_nodes).select("bucket", "node").join(nodes.select("node", "n_shingles", "sig"), "node")
    small = small.groupBy("bucket").agg(F.collect_list(F.struct("node", "n_shingles", "sig")).alias("members"))
    forest = small.select("members").mapInArrow(_forest(n_perms, bits, percent, slack), "a binary, b binary")
    stars = shared.where((F.col("n") > bucket_nodes) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return forest.unionByName(stars).distinct()


def bit_rows(sets: list[np.ndarray], most: int = BIT_ROWS_BYTES) -> np.ndarray | None:
    """Sets as rows of bits over the members that more than one of them has; None if that takes too many bytes."""
    sizes = np.array([len(s) for s in sets])
    found, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    width = -(-int((seen > 1).sum()) // 64)
    if len(sets) * width * 8 > most:
        return None
    place = np.cumsum(seen > 1) - 1
    at = np.flatnonzero(seen[code] > 1)
    bit, row = place[code[at]], np.repeat(np.arange(len(sets)), sizes)[at]
    rows = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(rows, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return rows


def _same(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(nodes: list[bytes], sets: list[np.ndarray], sigs: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int, floor: float, n_perms: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the exact similarity graph, within left or between left and right.

    root tells what is connected already: nodes of equal roots aren't compared.
    """
    sizes, out, rows = np.array([len(s) for s in sets]), [], bit_rows(sets)
    for at, i in enumerate(left.tolist()):
        rest = left[at + 1 :] if right is None else right
        rest = rest[(root[rest] != root[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
        if not len(rest):
            continue
        near = estimates(sigs[i], sigs[rest], n_perms)
        if rows is not None:
            rest = rest[near >= floor]
            both = np.bitwise_count(rows[rest] & rows[i]).sum(axis=1, dtype=np.int64)
            rest = rest[100 * both >= percent * (sizes[rest] + sizes[i] - both)]
            out.extend((nodes[i], nodes[j]) for j in _unite(root, i, rest))
            continue
        order = np.argsort(-near, kind="stable")
        for j in rest[order[: int((near >= floor).sum())]].tolist():
            if root[i] != root[j] and _same(sets[i], sets[j], percent):
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
    return out


def _confirmed(tasks: DataFrame, percent: int, floor: float, n_perms: int, bits: int) -> DataFrame:
    """Exact links a, b of tasks: component, x, y, side, label, node, sig, shingles.

    A task is a group by component, x and y: all of side 0, or side 0 against side 1. Nodes
    of one label are connected already.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "side"])
        nodes, sides = rows["node"].tolist(), rows["side"].to_numpy()
        known: dict[bytes, int] = {}
        root = np.array([known.setdefault(x, len(known)) for x in rows["label"]])
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sigs = unpacked(rows["sig"].tolist(), bits)
        at = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        across = bool(rows["across"].iloc[0])
        found = [] if across and not (len(at[0]) and len(at[1])) else _links(nodes, sets, sigs, root, at[0], at[1] if across else None, percent, floor, n_perms)
        return pd.DataFrame(found, columns=["a", "b"])

    return tasks.groupBy("component", "x", "y").applyInPandas(run, "a binary, b binary")


_TASK = ("component", "x", "y", "side", "across", "label", "node", "sig", "shingles")


def _within(rows: DataFrame) -> DataFrame:
    """Each block with itself."""
    return rows.select("component", F.col("block").alias("x"), F.col("block").alias("y"), F.lit(0).alias("side"), F.lit(False).alias("across"), F.col("node").alias("label"), "node", "sig", "shingles")


def _between(rows: DataFrame) -> DataFrame:
    """Each block with itself and with each other block of its cluster, once."""
    meets = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    return meets.select("component", x.alias("x"), y.alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"), (x != y).alias("across"), "label", "node", "sig", "shingles")


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """rows with parts, the number of blocks of their cluster, and block."""
    weights = rows.groupBy("component").agg(F.ceil(F.sum(F.octet_length("shingles")) / 8 / limit).cast("int").alias("parts"))
    return rows.drop("parts", "block").join(weights, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))


def _labelled(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    return rows.drop("label").join(connected_components(links, name).withColumnRenamed("component", "known"), "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")


def _large(rows: DataFrame, inner: DataFrame, limit: int, *how) -> DataFrame:
    """The links of clusters of several blocks, beyond those within the blocks (inner).

    The blocks' components are represented by a node each, and representatives are compared
    first: a large group of near copies is one component after that. Only nodes outside
    their cluster's largest component are then compared with all the others.
    """
    labelled = _labelled(rows, inner, "blocks")
    first = materialize(_confirmed(_between(_blocks(labelled.where("node = label"), limit)), *how), "first-links")
    labelled = materialize(_labelled(rows, inner.unionByName(first), "joined"), "labelled")
    sizes = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    apart = labelled.join(largest, "component")
    minor = _blocks(apart.where("label != main").withColumnRenamed("parts", "all_parts"), limit)
    # Block m of the minor nodes meets every block of all nodes.
    left = minor.select("component", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("y"), F.lit(0).alias("side"), F.lit(True).alias("across"), "label", "node", "sig", "shingles")
    numbers = minor.groupBy("component").agg(F.max("parts").alias("minor_parts"))
    right = apart.join(numbers, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("minor_parts") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), F.lit(True).alias("across"), "label", "node", "sig", "shingles")
    return first.unionByName(_confirmed(left.select(*_TASK).unionByName(right.select(*_TASK)), *how))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, slack: float = 0.17, bucket_nodes: int = 1024, cluster_shingles: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", with_node: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of docs; and node, the digest of its set."""
    with scratch(ready(docs.sparkSession)) as keep:
        return keep(_near(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), percent, width, bands, rows, bits, slack, bucket_nodes, cluster_shingles, with_node), "near")


def _near(texts: DataFrame, percent: int, width: int, bands: int, rows: int, bits: int, slack: float, bucket_nodes: int, cluster_shingles: int, with_node: bool) -> DataFrame:
    sketched = materialize(_sketch(texts, width, bands, rows, bits), "sketch")
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"))
    nodes = materialize(nodes, "nodes")
    n_perms, floor = bands * rows, percent / 100 - slack
    clusters = connected_components(_candidates(nodes, n_perms, bits, percent, slack, bucket_nodes), "cluster")
    members = nodes.drop("buckets").join(clusters, "node")
    weights = members.groupBy("component").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("weight") / cluster_shingles).cast("int")
    members = materialize(members.join(weights, "component").select("node", "least", "sig", "component", parts.alias("parts")), "members")
    how = (percent, floor, n_perms, bits)
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sets = _sets(texts, members.where("parts <= 1"), width).withColumn("block", F.lit(0))
    links = materialize(_confirmed(_within(sets), *how), "links")
    if not members.where("parts > 1").isEmpty():
        rows_of = materialize(_sets(texts, members.where("parts > 1"), width).withColumn("block", block), "sets")
        inner = materialize(_confirmed(_within(rows_of), *how), "inner-links")
        links = links.unionByName(inner).unionByName(_large(rows_of, inner, cluster_shingles, *how))
    linked = connected_components(links, "linked")
    least = nodes.select("node", "least").join(linked, "node").groupBy("component").agg(F.min("least").alias("head"))
    heads = linked.join(least, "component").select("node", "head")
    told = nodes.select("node", "least").join(heads, "node", "left").select("node", F.coalesce("head", "least").alias("head"))
    out = sketched.select("doc_id", "n_shingles", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), *["node"] * with_node)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = STAGE_PERCENT, bands: int = STAGE_BANDS, **options) -> DataFrame:
    """One row of docs, with all its columns, of each near-duplicate group: that of the least doc_id.

    Rows without words stay. Rows that share a doc_id (or have none) are told apart by their texts'
    digests, and of equal ones one stays; only they are hashed again.
    """
    found = near_duplicates(docs, percent=percent, width=width, bands=bands, id_col=id_col, text_col=text_col, with_node=True, **options)
    key, mark = free_name(docs, "own_id"), free_name(docs, "own_node")
    repeated = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(key)), "repeated")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    # Only rows that may have one of these ids are joined; of the others no text is shuffled.
    sure, docs = _split(docs, id_col, dropped.union(repeated).select(F.col(key).alias("doc_id")))
    plain = lambda own: docs[f"`{id_col}`"].eqNullSafe(own[key])
    if repeated.isEmpty():
        return sure.union(docs.join(dropped, plain(dropped), "left_anti"))
    single = docs.join(repeated, plain(repeated), "left_anti")
    single = sure.union(single.join(dropped, single[f"`{id_col}`"].eqNullSafe(dropped[key]), "left_anti"))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            sets = (shingles(t.lower().split(), width) for t in as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(s) if len(s) else None for s in sets], pa.binary())], names=[*batch.schema.names, mark])

    several = map_rows(docs.join(repeated, plain(repeated), "left_semi"), run, [StructField(mark, BinaryType())])
    kept = found.where("kept and node is not null").select(F.col("doc_id").alias(key), F.col("node").alias("kept_node")).distinct()
    same = several[id_col].eqNullSafe(kept[key]) & (several[mark] == kept["kept_node"])
    one = several.where(F.col(mark).isNotNull()).join(kept, same, "left_semi").dropDuplicates([id_col, mark])
    return single.unionByName(one.drop(mark)).unionByName(several.where(F.col(mark).isNull()).drop(mark))


def _sets(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The members with their shingle sets, made again from the text of their least doc_id.

    The digest tells rows that share an id apart. Nodes of rows without an id are found among
    those rows by their digests.
    """
    if not members.where("least is null").isEmpty():
        anonymous = texts.where("doc_id is null").select("text", F.lit(None).cast("binary").alias("node"))
        found = _shingled(anonymous, width).dropDuplicates(["node"]).join(members.where("least is null").drop("least"), "node")
        return _sets(texts, members.where("least is not null"), width).unionByName(found)
    rows = _may_be_among(texts, members.select(F.col("least").alias("doc_id"))).join(members.withColumnRenamed("least", "doc_id"), "doc_id")
    extra = ["sig", "component", "parts"]
    return _shingled(rows.select("text", "node", *extra), width, extra)


def _may_be_among(texts: DataFrame, ids: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose doc_id is among ids, and a few others: a Bloom filter, as a table of words, within the scan.

    The table is broadcast and has at most ``words`` rows however many ids there are; beyond some 10 million ids it
    lets ever more other rows pass, and the join that follows is still exact.
    """
    rows = texts.select("doc_id", "text", _filter_word("doc_id", words)).join(F.broadcast(_filter_table(ids, words)), "filter_word")
    return rows.where(F.col("filter_bits").bitwiseAND(_filter_bit("doc_id")) != 0).select("doc_id", "text")


def _filter_word(id_col: str, words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.lit(11)), 6), F.lit(words)).alias("filter_word")


def _filter_bit(id_col: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(xxhash64(`{id_col}`, 11) & 63 as int))")


def _filter_table(ids: DataFrame, words: int) -> DataFrame:
    """filter_word, filter_bits of ids' doc_id; at most ``words`` rows."""
    return ids.select(_filter_word("doc_id", words), _filter_bit("doc_id").alias("bit")).groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))


def _split(docs: DataFrame, id_col: str, ids: DataFrame, words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is certainly not among ids, and the others, by the same filter; ids may be null."""
    word, held, may = (free_name(docs, n) for n in ("filter_word", "filter_bits", "may_be"))
    table = _filter_table(ids, words).toDF(word, held)
    marked = docs.withColumn(word, _filter_word(id_col, words)).join(F.broadcast(table), word, "left")
    marked = marked.withColumn(may, F.coalesce(F.col(held).bitwiseAND(_filter_bit(id_col)) != 0, F.lit(False)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~F.col(may)).select(own), marked.where(F.col(may)).select(own)


def _shingled(rows: DataFrame, width: int, extra: list[str] = []) -> DataFrame:
    """node and shingles of each text, where node isn't another one's; and extra columns."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                mine, nodes, made = [], [], []
                for i, (text, node) in enumerate(zip(as_bytes(part.column("text")), part.column("node").to_pylist())):
                    s = shingles(text.lower().split(), width)
                    if len(s) and (node is None or digest(s) == node):
                        mine.append(i)
                        nodes.append(digest(s))
                        made.append(s.tobytes())
                part = part.take(pa.array(mine, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(made, pa.binary()), *(part.column(c) for c in extra)], names=["node", "shingles", *extra])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra]
    return rows.mapInArrow(run, ", ".join(["node binary", "shingles binary", *kinds]))
