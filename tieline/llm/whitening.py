"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum of what it has read: count, mean, eigenvalues
and eigenvectors of the scatter about the mean.  A further vector changes the
scatter by one centred rank-one term, so the new eigenvalues are the roots of a
secular equation; directions in which nothing changes, and equal eigenvalues,
are deflated first.  Two spectra are put together by one rank-one update for
each eigenvector of the smaller and one for the distance of their means, in
rounds of ``FAN`` spectra a group.  The merged basis is then refined over all
rows: the covariance is projected on it exactly centred, by a distributed sum,
and the projection is solved (Rayleigh-Ritz).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut

SCALE, SHIFT = 1024, 100_000
FAN = 16  # spectra merged in one task
COMPONENTS = 8
_SPECTRUM = "part bigint, n bigint, mean array<double>, values array<double>, vectors array<double>"


class Spectrum(NamedTuple):
    """Scatter about the mean of ``n`` rows: ``vectors @ diag(values) @ vectors.T``, values rising."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z**2 / (d - x)) = 0 for rising, different ``d``, no ``z`` zero.

    One root lies above each d, below the next.  It is kept as the nearer of
    these two poles and the distance from it, which loses no digits where both
    are close.  Times that distance the equation has no pole near by, so Newton's
    rule converges; a step out of the bracket is replaced by a halving.  Returns
    (pole number, distance).
    """
    n, squares = len(d), z * z
    here = np.arange(n)
    last = here == n - 1
    gap = np.append(np.diff(d), squares.sum())
    at_middle = 1 + (squares / (d - (d + gap / 2)[:, None])).sum(1)
    near = np.where((at_middle >= 0) | last, here, here + 1)
    own = near == here
    poles = d[None, :] - d[near][:, None]
    low = np.where(own, 0.0, -gap / 2)
    high = np.where(own, np.where(last, gap, gap / 2), 0.0)
    others = np.broadcast_to(squares, (n, n)).copy()
    others[here, near] = 0.0
    poles[here, near] = np.inf
    pole = squares[near]
    # the other pole of the bracket: its weight and distance; the last root has none
    across = np.where(own, np.minimum(here + 1, n - 1), here)
    weight, reach = np.where(last, 0.0, squares[across]), np.where(last, 2 * gap, np.where(own, gap, -gap))
    x = (low + high) / 2
    for turn in range(100):
        ratio = others / (poles - x[:, None])
        rest = 1 + ratio.sum(1)
        value = x * rest - pole  # has the sign of x times the equation
        right = (value < 0) == (x > 0)
        low, high = np.where(right, x, low), np.where(right, high, x)
        if turn < 3:  # two poles and a constant for all others: a quadratic
            c = rest - weight / (reach - x)
            b = c * reach + pole + weight
            root = np.sqrt(np.maximum(b * b - 4 * c * pole * reach, 0.0))
            step = 2 * pole * reach / np.where(b > 0, b + root, b - root)
        else:
            step = x - value / (rest + x * (ratio / (poles - x[:, None])).sum(1))
        new = np.where((step >= low) & (step <= high) & (step != 0), step, (low + high) / 2)
        still = np.abs(new - x) > 1e-14 * np.abs(new)
        x = new
        if not still.any():
            break
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of ``vectors diag(values) vectors.T + weight v v.T``, weight > 0."""
    z = vectors.T @ v
    norm = np.sqrt(z @ z)
    if not weight > 0 or not norm > 0:
        return values, vectors
    rho, z = weight * norm * norm, z / norm
    size = max(np.abs(values).max(), rho)
    least = 8 * np.finfo(float).eps * size
    # equal eigenvalues: turn their directions so that only the last of them meets the update
    turned = vectors
    gaps = np.diff(values) <= least
    if gaps.any():
        turned = vectors.copy()
        for i in np.flatnonzero(gaps):
            r = np.hypot(z[i], z[i + 1])
            if r > 0:
                c, s = z[i + 1] / r, z[i] / r
                a, b = turned[:, i].copy(), turned[:, i + 1].copy()
                turned[:, i], turned[:, i + 1] = c * a - s * b, s * a + c * b
                z[i], z[i + 1] = 0.0, r
    moved = rho * np.abs(z) > least
    if not moved.any():
        return values, turned
    d, k = values[moved] / rho, int(moved.sum())
    near, away = secular_roots(d, z[moved])
    # d_i - root_j without cancellation, and the update for which these roots are exact
    distance = (d[:, None] - d[near][None, :]) - away[None, :]
    between = d[None, :] - d[:, None]
    between[np.arange(k), np.arange(k)] = 1.0
    exact = np.sqrt(np.abs(distance / between).prod(1)) * np.sign(z[moved])
    w = exact[:, None] / distance
    w /= np.sqrt((w * w).sum(0))
    new_values, new_vectors = values.copy(), turned.copy()
    new_values[moved] = (d[near] + away) * rho
    new_vectors[:, moved] = turned[:, moved] @ w
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def with_row(s: Spectrum, x: np.ndarray) -> Spectrum:
    """The spectrum after one more row; ``n`` 0 stands for no rows yet."""
    if not s.n:
        return Spectrum(1, x, s.values, s.vectors)
    away = x - s.mean
    values, vectors = rank_one(s.values, s.vectors, s.n / (s.n + 1), away)
    return Spectrum(s.n + 1, s.mean + away / (s.n + 1), values, vectors)


def merged(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of the rows of both."""
    if a.n < b.n:
        a, b = b, a
    values, vectors = a.values, a.vectors
    for weight, v in zip(b.values, b.vectors.T):
        values, vectors = rank_one(values, vectors, float(weight), v)
    away, n = b.mean - a.mean, a.n + b.n
    values, vectors = rank_one(values, vectors, a.n * b.n / n, away)
    return Spectrum(n, a.mean + away * (b.n / n), values, vectors)


def _empty(d: int) -> Spectrum:
    return Spectrum(0, np.zeros(d), np.zeros(d), np.eye(d))


def _row(part: int, s: Spectrum) -> dict:
    return {"part": part, "n": s.n, "mean": s.mean, "values": s.values, "vectors": s.vectors.ravel()}


def _spectrum(row) -> Spectrum:
    mean = np.asarray(row.mean, float)
    return Spectrum(int(row.n), mean, np.asarray(row.values, float), np.asarray(row.vectors, float).reshape(len(mean), -1))


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as whole numbers floor(1024 c) + 100000, of rows without null or non-finite entries.

    Entries beyond 2**33 in size count as that.
    """
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    e = F.col(embedding)
    kept = rows.where(e.isNotNull() & (F.size(e) > 0) & F.coalesce(F.forall(e, good), F.lit(False)))
    most = F.lit(float(2**33))
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(c.cast("double"), -most), most) * SCALE) + SHIFT)
    return kept.select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def spectra(x: DataFrame, d: int) -> DataFrame:
    """One spectrum a partition, with its exact sums as text."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, sums = _empty(d), [0] * d
        for batch in batches:
            m = _matrix(batch, d)
            sums = [a + b for a, b in zip(sums, m.sum(0).tolist())]
            for row in m.astype(float):
                s = with_row(s, row)
        if s.n:
            made = _row(TaskContext.get().partitionId(), s) | {"sums": [str(v) for v in sums]}
            yield pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in made.items()}])

    return x.select("x").mapInArrow(fit, f"{_SPECTRUM}, sums array<string>")


def merge_spectra(found: DataFrame) -> Spectrum:
    """All spectra as one, in rounds of ``FAN`` a task."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = [_spectrum(r) for r in rows.sort_values("part").itertuples()]
        total = ordered[0]
        for s in ordered[1:]:
            total = merged(total, s)
        return pd.DataFrame([_row(int(rows["part"].iloc[0]), total)])

    left = found.agg(F.max("part")).first()[0] + 1
    found = found.drop("sums")
    while left > 1:
        found = cut(found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(merge, _SPECTRUM))
        left = -(-left // FAN)
    return _spectrum(found.first())


def _centred(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean; the difference is taken in whole numbers, n times as large."""
    return _deviations(m, n, sums).astype(float) / n


def _deviations(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    largest = n * int(np.abs(m).max(initial=0)) + max(map(abs, sums))
    if largest < 2**62:
        return m * n - np.array(sums, np.int64)
    return m.astype(object) * n - np.array(sums, object)


def projected_moments(x: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean product of the centred rows on the basis, summed by Spark; only these reach the driver."""
    d, k = basis.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = _centred(_matrix(batch, d), n, sums) @ basis
            first += y.sum(0)
            second += y.T @ y
        yield pa.RecordBatch.from_pydict({"moments": pa.array([np.concatenate([first, second.ravel()]).tolist()])})

    rows = x.select("x").mapInArrow(add, "moments array<double>").select(F.posexplode("moments").alias("at", "value"))
    total = np.zeros(k + k * k)
    for r in rows.groupBy("at").agg(F.sum("value").alias("value")).toLocalIterator():
        total[r["at"]] = r["value"]
    return total[:k] / n, total[k:].reshape(k, k) / n


class Whitening(NamedTuple):
    """Components (columns, unit, by falling eigenvalue) of the fitted rows; all lists are empty without rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(x: DataFrame, d: int, components: int = COMPONENTS, refinements: int = 3) -> Whitening:
    """Incremental spectrum of all rows, refined until the whitened covariance is the identity to 1e-9."""
    found = cut(spectra(x, d))
    exact = found.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    rows = sorted(exact.collect())
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    basis = np.linalg.qr(merge_spectra(found).vectors)[0]
    for _ in range(refinements):
        _, h = projected_moments(x, basis, n, sums)
        values, turn = np.linalg.eigh((h + h.T) / 2)
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
        values, trace = np.maximum(values[::-1], 0.0), float(np.trace(h))
        first = basis[:, :components] * np.where(basis[np.abs(basis).argmax(0), np.arange(d)] < 0, -1, 1)[:components]
        top = values[:components]
        real = top > 1e-12 * max(values[0], 1e-300)
        error = 0.0
        if real.any():
            mean, second = projected_moments(x, first[:, real] / np.sqrt(top[real]), n, sums)
            error = float(np.abs(second - np.outer(mean, mean) - np.eye(int(real.sum()))).max())
        if error < 1e-9:
            break
    return Whitening(n, sums, np.where(real, top, 0.0), first, trace, error)


def whiten(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component, numbered from 1 by falling eigenvalue.

    Columns: vec_id, component, n (vectors fitted), deviation (sum of (n x - S)**2
    over the dimensions, exact, null beyond a bigint), whitened, explained (share
    of the trace) and identity_error (one value).  Left out are rows whose vector
    is null, empty, has a null or non-finite entry, or another length than most
    (of lengths as frequent, the larger counts).  Repeated rows count and come
    back each.  A component without variance has ``whitened`` null and
    ``explained`` 0, null where nothing varies.  No rows give none; other columns
    are not read.  The driver holds squares of the dimension, never rows.
    """
    x = whole_vectors(rows, vec_id, embedding)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    name = x.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {name}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = lengths["d"]
    x = x.where(F.size("x") == d)
    w = fit(x, d, components)
    k = len(w.values)
    scale = np.divide(1.0, np.sqrt(w.values), out=np.full(k, np.nan), where=w.values > 0)
    explained = [float(v) / w.trace if w.trace > 0 else None for v in w.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch, d)
            away = _deviations(m, w.n, w.sums)
            y = (away.astype(float) / w.n @ w.vectors) * scale
            largest = float(np.abs(away.astype(float)).max(initial=0))
            if d * largest * largest < 2**62:
                far = (away * away).sum(1)
            else:
                far = [v if v < 2**63 else None for v in (away.astype(object) ** 2).sum(1)]
            white = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel(), from_pandas=True), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(far, pa.int64()), white], ["vec_id", "deviation", "white"])

    made = x.mapInArrow(project, f"vec_id {name}, deviation bigint, white array<double>")
    share = F.array(*[F.lit(v).cast("double") for v in explained])
    return made.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(w.identity_error).alias("identity_error"),
    )
