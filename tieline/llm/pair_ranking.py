"""Document quality by Bradley-Terry ranking: scores learned from preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.llm.quality_rules import STOP_WORDS, SYMBOLS
from tieline.llm.text import LOWER, SPACES, UPPER, lowered, whole, words

SAMPLE = 20_000  # labelled rows of each class, lowest hashes first
PAIRS = 8  # preferred partners of each sampled row
RIDGE = 1e-3
CUT = 0.7  # score at the chosen quantile
DIGITS = "0123456789"


def features(text: str) -> dict[str, Column]:
    """What a text looks like; the columns ``_w`` (words) and ``_lines`` are made before."""
    t = whole(text)
    length = F.length(t)
    count = lambda characters: length - F.length(F.translate(t, characters, ""))
    share = lambda part: part / F.greatest(length, F.lit(1))
    n, lines = F.size("_w"), F.size("_lines")
    distinct = F.size(F.array_distinct("_w"))
    stop = F.size(F.filter(F.transform("_w", lowered), lambda x: x.isin(STOP_WORDS)))
    per_word = lambda part: part / F.greatest(n, F.lit(1))
    symbols, capitals = share(count(SYMBOLS)), share(count(UPPER))
    return {
        "symbols": F.least(symbols, F.lit(0.1)),
        "any symbols": (symbols > 0.005).cast("double"),
        "capitals": F.least(capitals, F.lit(0.3)),
        "small letters": share(count(LOWER)),
        "calls": F.least(share(count("!?")), F.lit(0.1)),
        "digits": share(count(DIGITS)),
        "stops": share(count(".,;:")),
        "word length": F.least(per_word(F.length(F.translate(t, SPACES, ""))), F.lit(20.0)),
        "log words": F.log1p(n.cast("double")),
        "richness": F.when(n > 1, F.log1p(distinct.cast("double")) / F.log1p(n.cast("double"))).otherwise(1.0),
        "rare repeats": F.greatest(per_word(distinct), F.lit(0.3)),
        "repeated lines": (lines - F.size(F.array_distinct("_lines"))) / F.greatest(lines, F.lit(1)),
        "stop words": F.least(per_word(stop), F.lit(0.3)),
        "lines per word": F.least(per_word(lines), F.lit(0.3)),
    }


def prepared(docs: DataFrame, text: str) -> DataFrame:
    t = whole(text)
    filled = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return docs.withColumn("_w", words(t)).withColumn("_lines", filled)


@dataclass(frozen=True)
class Ranking:
    """Linear scores with the mean and spread of each feature, and the cut among scores."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    prior: float | None = None  # set where nothing can be learned


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights that make every preferred row score higher: logistic loss on feature differences.

    Each row of either class meets ``pairs`` rows of the other, chosen by a fixed
    stride, so the number of pairs grows with the rows and not with their product.
    """
    stride = lambda n, m: (np.repeat(np.arange(n), pairs) * 7919 + np.tile(np.arange(pairs), n) * 104729) % m
    a = np.concatenate([np.repeat(np.arange(len(good)), pairs), stride(len(bad), len(good))])
    b = np.concatenate([stride(len(good), len(bad)), np.repeat(np.arange(len(bad)), pairs)])
    x = good[a] - bad[b]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))  # chance that the preferred one wins
        gradient = x.T @ (1 - p) / len(x) - ridge * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> Ranking:
    """Learn from ``labels`` (doc_id, 0 or 1) on at most ``sample`` rows of each class.

    Rows are sampled by hash of their id; ids with a null or with both labels are
    not used.  Without rows of both classes there are no pairs: every text then
    scores the share of label 1, or 0.5 without labels.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    known = known.agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_id", "_y")
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * sample narrow rows
    used = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    looks = [v.cast("double") for v in features("_text").values()]
    made = prepared(used, "_text").select("_y", F.array(*looks).alias("x")).toArrow()
    y = made.column("_y").to_numpy()
    x = np.array(made.column("x").to_pylist(), np.float64).reshape(len(y), len(looks))
    order = np.lexsort((*x.T, y))  # neither sums nor pairs may depend on the order of arrival
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        return Ranking((), (), (), 0.0, float(y.mean()) if len(y) else 0.5)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = (x - mean) / spread
    w = fit_pairs(z[y == 1], z[y == 0])
    s = z @ w
    # the quantile of all scores that tells the classes apart best
    cuts = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    right = [(s[y == 1] >= c).mean() + (s[y == 0] < c).mean() for c in cuts]
    best = int(np.argmax(right))
    below = s[s < cuts[best]]
    cut = (cuts[best] + below.max()) / 2 if len(below) else cuts[best]
    return Ranking(*(tuple(map(float, v)) for v in (mean, spread, w)), float(cut))


def score(docs: DataFrame, ranking: Ranking, *, text: str = "text", low: float = CUT) -> DataFrame:
    """``docs`` with ``score`` in 0..1 and ``predicted`` (score >= 0.7), for every row and whole texts.

    Null and empty texts are scored as texts without words.  Repeated rows score
    alike; columns named ``score`` or ``predicted`` are replaced; others stay.
    """
    if ranking.prior is not None:
        value = F.lit(ranking.prior)
        return docs.withColumn("score", value).withColumn("predicted", (value >= low).cast("int"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    total = F.lit(-ranking.cut)
    for f, m, s, w in zip(features("_text").values(), ranking.mean, ranking.spread, ranking.weights):
        total = total + (f - m) * (w / s)
    shifted = total + float(np.log(low / (1 - low)))
    made = prepared(packed, "_text").withColumn("_score", 1 / (1 + F.exp(-shifted)))
    kept = [f"_row.`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    return made.select(*kept, F.col("_score").alias("score"), (F.col("_score") >= low).cast("int").alias("predicted"))
