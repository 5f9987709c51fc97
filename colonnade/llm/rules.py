"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

1. Statistics of whole texts (``stats.text_stats``) become the shares and lengths of FEATURES.
2. On a bounded sample of labelled rows (``sample`` rows, those with the least hash of their ids)
   shallow trees are grown on the driver, each on a part of the rows and features. Every node but the
   root is a rule: the conjunction of the comparisons on its path.
3. A lasso-penalised logistic regression gives the rules weights, most of them zero.
4. The rules left are summed in one SQL expression, so scoring stays in generated JVM code.

Learning uses only labelled rows outside the held-out fifth, ``crc32(doc_id as text) % 5 != 0``.

Edge cases: a null or empty text has zero counts and a score like any other; rows without a
label don't teach; with no label, or of one kind only, the score is the share of label 1 (0.5 without
any); repeated rows are each scored, and of rows that share a labelled id one teaches; very long texts are counted
whole; an empty table gives no row; other columns, whatever their names, are kept by ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import free_name, map_rows, ready
from .stats import COUNTS, counts
from .text import as_bytes

#: Of the arrays of COUNTS, by name.
FEATURES = {
    "log_words": lambda c: np.log(c["n_words"] + 1),
    "word_length": lambda c: c["word_chars"] / (c["n_words"] + 1),
    "symbol_share": lambda c: c["n_symbols"] / (c["n_words"] + 1),
    "pipe_share": lambda c: c["n_pipes"] / (c["n_words"] + 1),
    "repeat_share": lambda c: c["n_repeat_words"] / (c["n_words"] + 1),
    "distinct_share": lambda c: c["n_distinct_words"] / (c["n_words"] + 1) * np.log(c["n_words"] + 2),
    "dup_line_share": lambda c: c["n_dup_lines"] / (c["n_lines"] + 1),
    "upper_share": lambda c: c["n_upper"] / (c["n_upper"] + c["n_lower"] + 1),
    "exclaim_share": lambda c: c["n_exclaims"] / (c["n_words"] + 1),
    "digit_share": lambda c: c["n_digits"] / (c["n_words"] + 1),
    "mark_share": lambda c: c["n_marks"] / (c["n_words"] + 1),
    "line_words": lambda c: np.log(c["n_words"] / (c["n_lines"] + 1) + 1),
}
NAMES = list(FEATURES)

Test = tuple[int, bool, float]  # feature, above, threshold


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[float, tuple[Test, ...]]]

    def sql(self, names: dict[str, str] | None = None) -> str:
        """The score over columns named as FEATURES, or as names has them."""
        terms = [repr(self.intercept)]
        for weight, tests in self.rules:
            terms.append(f"IF({' AND '.join(f'`{(names or {}).get(NAMES[f], NAMES[f])}` {">" if above else "<="} {at!r}D' for f, above, at in tests)}, {weight!r}D, 0D)")
        return f"1D / (1D + exp(-({'D + '.join(terms[:1])}D + {' + '.join(terms[1:]) or '0D'})))"

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for weight, tests in self.rules:
            z += weight * covers(tests, x)
        return 1 / (1 + np.exp(-z))


def covers(tests: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, at in tests:
        out &= (x[:, f] > at) if above else (x[:, f] <= at)
    return out


def _grow(x: np.ndarray, y: np.ndarray, features: np.ndarray, depth: int, path: tuple[Test, ...], out: list) -> None:
    """Adds the rules of a tree that is split by Gini impurity at up to 24 quantiles a feature."""
    if path:
        out.append(path)
    n, ones = len(y), y.sum()
    if not depth or n < 20 or ones in (0, n):
        return
    best = (2 * ones * (n - ones) / n - 1e-9, -1, 0.0)
    for f in features:
        values = x[:, f]
        cuts = np.unique(np.quantile(values, np.linspace(0.02, 0.98, 24)))
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(values[order], cuts, side="right")
        below = np.concatenate([[0], np.cumsum(y[order])])[at]
        fine = (at >= 5) & (n - at >= 5)
        if not fine.any():
            continue
        a, b = at[fine], below[fine]
        rising = values[order]
        cuts = (rising[a - 1] + rising[a]) / 2  # between two rows, as far from either as can be
        cost = 2 * b * (a - b) / a + 2 * (ones - b) * (n - a - ones + b) / (n - a)
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (cost[k], int(f), float(cuts[k]))
    _, f, at = best
    if f < 0:
        return
    low = x[:, f] <= at
    _grow(x[low], y[low], features, depth - 1, (*path, (f, False, at)), out)
    _grow(x[~low], y[~low], features, depth - 1, (*path, (f, True, at)), out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 300, seed: int = 7) -> RuleEnsemble:
    """Rules and lasso weights of labels y (0 or 1) by rows of FEATURES."""
    y = y.astype(float)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 10:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    rng = np.random.default_rng(seed)
    found: list[tuple[Test, ...]] = []
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), max(200, len(y) // 4)), replace=False)
        _grow(x[rows], y[rows], rng.choice(len(NAMES), max(2, len(NAMES) // 3), replace=False), depth, (), found)
    rules = list(dict.fromkeys(found))
    cover = np.stack([covers(r, x) for r in rules], 1)
    keep, seen = [], set()
    for k in range(len(rules)):  # one of the rules that cover the same rows
        key = cover[:, k].tobytes()
        if key not in seen and 0 < cover[:, k].sum() < len(y):
            seen.add(key)
            keep.append(k)
    if not keep:
        return RuleEnsemble(math.log(share / (1 - share)), [])
    rules, a = [rules[k] for k in keep], cover[:, keep].astype(np.float32)
    mean, scale = a.mean(0), np.maximum(a.std(0), 0.02)
    a = (a - mean) / scale
    # Accelerated proximal gradient: the step is the inverse of the loss's curvature.
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(np.linalg.norm(a.T @ (a @ v)))
    w = np.zeros(a.shape[1], np.float32)
    u, b, t = w, math.log(share / (1 - share)), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ u + b))) - y
        new = u - step * (a.T @ r.astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4 * float(r.mean())
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / s * (new - w)
        w, t = new, s
    weights = w / scale
    return RuleEnsemble(b - float((weights * mean).sum()), [(float(weights[k]), rules[k]) for k in np.flatnonzero(w)])


def add_features(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns and the FEATURES of the texts behind them, under names that docs doesn't have."""
    ready(docs.sparkSession)
    names = {n: free_name(docs, n) for n in NAMES}
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = np.array([counts(t) for t in as_bytes(batch.column(at))], float).reshape(batch.num_rows, len(COUNTS))
            columns = dict(zip(COUNTS, found.T))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f(columns), pa.float64()) for f in FEATURES.values())], names=[*batch.schema.names, *names.values()])

    return map_rows(docs, run, [StructField(n, DoubleType()) for n in names.values()]), names


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """Fits on at most ``sample`` labelled rows outside the held-out fifth."""
    told = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    told = told.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(told), "label_id")
    # However many rows share an id, one teaches: what comes to the driver is bounded by the sample.
    one = rows.groupBy("label_id", "label").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("row"))
    got = add_features(one.select("label", F.col("row.text").alias("text")))[0].drop("text").toPandas()
    got = got.sort_values([*NAMES, "label"])  # whatever order the tasks came in
    return fit(got[NAMES].to_numpy(float), got["label"].to_numpy(int))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    told, _ = add_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    told = told.select("doc_id", F.expr(model.sql()).alias("score"))
    return told.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score at least the threshold, with all their columns; nothing is shuffled."""
    told, names = add_features(docs, text_col)
    return told.where(F.expr(model.sql(names)) >= threshold).select(*(told[f"`{c}`"] for c in docs.columns))
