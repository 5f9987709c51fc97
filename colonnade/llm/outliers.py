"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Base rules reject first. The rest is described by vectors of transformed statistics, and each
group of language and source gets a minimum-covariance-determinant estimate of its centre and
scatter; documents too far off, in Mahalanobis distance, are rejected.

The estimate is made over all documents without holding a group in one place:

* medians and median deviations come from counts of quantised values, the second, correlated start
  from spatial signs; both are sums, aggregated map-side;
* a concentration step is one aggregation: documents are counted by group and by a fine bucket of
  their log distance, with the sums and cross products of their vectors. The buckets up to the one
  that completes the h nearest documents give the next centre and scatter;
* after ``steps`` steps the start with the smaller determinant stays, and one reweighting step
  uses all documents within the 97.5 % quantile.

A hot source is thus some hundred sums like any other. Groups of fewer than ``least`` documents
are put together with the others of their language that are, and such pools that still have fewer with each
other: estimates are of what is small in the corpus, not of the large groups beside it. ``FLOORS`` are the least standard deviations,
so that a statistic that is constant in most of a group (no symbol at all) stays defined.

Edge cases: a null text has no words and is base-failed; null languages and sources are groups of
their own; a last pool of fewer than ``least`` documents rejects nobody; very long texts are vectors like
others; repeated rows are judged each; an empty table gives no row; columns of any name beside the four don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .stats import COUNTS, text_stats

#: Name, expression over COUNTS and the least standard deviation of each coordinate. Shares are
#: shrunk by some words of neutral text, so that short texts don't scatter more than long ones.
FEATURES = {
    "log_words": ("ln(n_words + 1)", 0.5),
    "word_length": ("(word_chars + 5.0 * 40) / (n_words + 40)", 0.4),
    "symbols": ("ln(1 + 100.0 * n_symbols / (n_words + 20))", 0.4),
    "repeats": ("ln(1 + 100.0 * n_repeat_words / (n_words + 40))", 0.75),
    "upper": ("ln(1 + 100.0 * n_upper / (n_upper + n_lower + 100))", 0.35),
    "exclaims": ("ln(1 + 100.0 * n_exclaims / (n_words + 20))", 0.5),
}
P = len(FEATURES)
FLOORS = np.array([f for _, f in FEATURES.values()])
PER_UNIT = 64
H_SHARE = 0.75
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    for k in range(1, 2000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-14:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(p / 2, mid / 2) < q else (lo, mid)
    return (lo + hi) / 2


def _consistency(share: float, p: int) -> float:
    """What the scatter of the nearest share of a normal cloud is too small by."""
    return 1.0 if share >= 1 else share / _gamma_p(p / 2 + 1, chi2_quantile(share, p) / 2)


def _parameters(mean: np.ndarray, cov: np.ndarray) -> dict:
    cov = cov + np.diag(np.maximum(0, FLOORS**2 - np.diag(cov)))
    inverse = np.linalg.inv(cov)
    return {"mean": mean.tolist(), "inverse": [inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS], "logdet": float(np.linalg.slogdet(cov)[1])}


def _square(rows: np.ndarray) -> np.ndarray:
    out = np.empty((P, P))
    for k, (i, j) in enumerate(PAIRS):
        out[i, j] = out[j, i] = rows[k]
    return out


def _moments(total: np.ndarray, factor: float) -> dict:
    """Parameters from n, P sums and the sums of PAIRS."""
    n, mean = total[0], total[1 : 1 + P] / total[0]
    return _parameters(mean, factor * (_square(total[1 + P :]) / n - np.outer(mean, mean)))


_START = "g string, start int, mean array<double>, inverse array<double>, logdet double"
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS)]


def _concentrate(rows: pd.DataFrame) -> pd.DataFrame:
    """The next parameters of one group and start, from its buckets by distance."""
    rows = rows.sort_values("bucket")
    held = rows["n"].cumsum().to_numpy()
    last = int(np.searchsorted(held, H_SHARE * held[-1])) + 1
    total = rows[_SUMS].to_numpy(float)[:last].sum(axis=0)
    new = _moments(total, _consistency(total[0] / held[-1], P))
    return pd.DataFrame([{"g": rows["g"].iloc[0], "start": int(rows["start"].iloc[0]), **new}])


def _reweigh(rows: pd.DataFrame) -> pd.DataFrame:
    new = _moments(rows[_SUMS].to_numpy(float).sum(axis=0), _consistency(0.975, P))
    return pd.DataFrame([{"g": rows["g"].iloc[0], "start": int(rows["start"].iloc[0]), **new}])


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])


def _first(rows: pd.DataFrame) -> pd.DataFrame:
    mean, scale = np.zeros(P), np.zeros(P)
    for k, own in rows.groupby("k"):
        values, n = own["q"].to_numpy(float) / PER_UNIT, own["n"].to_numpy(float)
        mean[k] = _median(values, n)
        scale[k] = 1.4826 * _median(np.abs(values - mean[k]), n)
    return pd.DataFrame([{"g": rows["g"].iloc[0], "start": 0, **_parameters(mean, np.diag(np.maximum(scale, FLOORS) ** 2))}])


def _second(rows: pd.DataFrame) -> pd.DataFrame:
    """Medians and median deviations with the correlations of spatial signs."""
    row = rows.iloc[0]
    inverse = _square(np.asarray(row["inverse"]) / [1 if i == j else 2 for i, j in PAIRS])
    scale = 1 / np.sqrt(np.diag(inverse))
    signs = _square(rows[_SUMS[1 + P :]].to_numpy(float)[0] / max(float(row["n"]), 1.0))
    spread = np.sqrt(np.diag(signs) + 1e-6)
    corr = signs / np.outer(spread, spread)
    np.fill_diagonal(corr, 1)
    return pd.DataFrame([{"g": row["g"], "start": 1, **_parameters(np.asarray(row["mean"]), 0.95 * corr * np.outer(scale, scale) + 0.05 * np.diag(scale**2))}])


def _distance(x: list[Column]) -> Column:
    """The squared Mahalanobis distance to the parameters in the row."""
    off = [x[i] - F.col("mean")[i] for i in range(P)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + F.col("inverse")[k] * off[i] * off[j]
    return F.greatest(out, F.lit(0.0))


def _sums(x: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in PAIRS)]


def fit(vectors: DataFrame, steps: int = 5) -> DataFrame:
    """g, mean, inverse, logdet of each group of vectors (g string, x0 .. double)."""
    x = [F.col(f"x{i}") for i in range(P)]
    quantised = vectors.select("g", F.posexplode(F.array(*(F.round(c * PER_UNIT).cast("int") for c in x))).alias("k", "q")).groupBy("g", "k", "q").agg(F.count(F.lit(1)).alias("n"))
    start = materialize(quantised.groupBy("g").applyInPandas(_first, _START), "mcd-start")
    z = [(x[i] - F.col("mean")[i]) * F.sqrt(F.col("inverse")[PAIRS.index((i, i))]) for i in range(P)]
    norm = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]) + F.lit(1e-12))
    signs = vectors.join(start, "g").select("g", *((c / norm).alias(f"u{i}") for i, c in enumerate(z)))
    signs = signs.groupBy("g").agg(*_sums([F.col(f"u{i}") for i in range(P)])).join(start, "g")
    params = start.unionByName(signs.groupBy("g").applyInPandas(_second, _START))
    for step in range(steps):
        near = vectors.join(params, "g").select("g", "start", F.floor(F.log(_distance(x) + 1e-9) * PER_UNIT / 4).cast("int").alias("bucket"), *x)
        sums = near.groupBy("g", "start", "bucket").agg(*_sums(x))
        params = materialize(sums.groupBy("g", "start").applyInPandas(_concentrate, _START), f"mcd-{step}")
    best = params.groupBy("g").agg(F.min(F.struct("logdet", "start", "mean", "inverse")).alias("b")).select("g", "b.start", "b.mean", "b.inverse", "b.logdet")
    inside = vectors.join(best, "g").where(_distance(x) <= chi2_quantile(0.975, P)).groupBy("g", "start").agg(*_sums(x))
    return materialize(inside.groupBy("g").applyInPandas(_reweigh, _START).drop("start"), "mcd")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 100, steps: int = 5, quantile: float = 0.9999) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (null without an estimate) and kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = text_stats(rows, ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialize(stats.select("*", failed.alias("base_failed"), *(F.expr(e).cast("double").alias(f"x{i}") for i, (e, _) in enumerate(FEATURES.values()))), "mcd-stats")
    passed = stats.where(~F.col("base_failed"))
    sizes = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("pooled"))
    names = sizes.alias("a").join(langs.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").select(F.col("a.lang").alias("lang_"), F.col("a.source").alias("source_"), F.when(F.col("n") >= least, F.to_json(F.struct(F.col("a.lang").alias("l"), F.col("a.source").alias("s"), F.lit(1).alias("by")))).when(F.col("pooled") >= least, F.to_json(F.struct(F.col("a.lang").alias("l"), F.lit(2).alias("by")))).otherwise("rest").alias("g"))
    named = passed.join(names, passed["lang"].eqNullSafe(F.col("lang_")) & passed["source"].eqNullSafe(F.col("source_"))).drop("lang_", "source_")
    vectors = materialize(named, "mcd-vectors")
    sized = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n_group")).where(F.col("n_group") >= least)
    x = [F.col(f"x{i}") for i in range(P)]
    params = fit(vectors.join(sized, "g", "left_semi").select("g", *x), steps)
    told = vectors.join(params, "g", "left").withColumn("distance", F.when(F.col("mean").isNotNull(), F.sqrt(_distance(x))))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    limit = math.sqrt(chi2_quantile(quantile, P))
    kept = F.coalesce(F.col("distance") <= limit, F.lit(True)).alias("kept")
    return told.select(*base, "distance", kept).unionByName(stats.where("base_failed").select(*base, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


assert set(COUNTS) >= {"n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_lower", "n_exclaims"}
