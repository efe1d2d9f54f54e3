"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two strings sums, over all sequences of ``ORDER`` letters that are
found in both, with gaps, the decays of the characters skipped in either; the
beginning and the end of a string count as letters.  Letters decay fast and all
other characters hardly, so "id-io.t" is near "idiot" and a longer word that
happens to hold the same letters is not.  A power of the kernel, a kernel again,
makes near strings stand out.  White space ends a match, except between single
characters ("i d i o t").  The kernel of a sentence with a string is therefore
the sum over its units, and equal units are looked at once.

A sentence is seen through its kernels with landmark strings (Nyström): units of
the labelled sample that cover many toxic and few clean documents, and some
drawn by hash.  A linear machine with squared hinge loss is trained on
sentences.  Labels are known for documents only: of a clean one all sentences
are clean, of a toxic one those near a landmark are taken for toxic at first,
and after each fit those on the toxic side, the highest one always.  A text
scores as its highest sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut
from tieline.llm.text import lowered, whole

ORDER, POWER = 3, 6  # letters of a common subsequence, and the power of the kernel
LETTER_DECAY, OTHER_DECAY = 0.6, 0.98
FLOOR = 0.3  # kernels below this share of the landmark's own count as 0
SHARED = 0.75  # kernels of strings that share less of the landmark's different letters count as 0
NEAR = 0.5  # a sentence of a toxic document with so large a kernel is toxic at first
BEGIN, END = "\x02", "\x03"
SAMPLE = 2_000  # labelled documents of each class that the machine is trained on
SENTENCES = 16  # of each of these, those with the largest kernels
CANDIDATES, COVERING, DRAWN = 400, 160, 8  # landmarks: looked at, taken for what they cover, taken by hash
LIGHT = 0.1  # landmarks with less than this share of the largest weight are left out, and the rest fitted again
DEEP = 5  # times that a toxic document is to be covered
SHORTEST = 3  # letters of a landmark
UNITS = 32  # longest sentence
WINDOW = 48  # longer units are read in windows of so many characters, each half over the last
CUT = 0.7
MEMORY = 1_000_000  # scores of units that a worker keeps
ENDS = (".", "!", "?")


def is_letter(points: np.ndarray) -> np.ndarray:
    """ASCII small letters, and what lies beyond Latin-1 signs without general punctuation."""
    ascii_letter = (points >= 97) & (points <= 122)
    return ascii_letter | ((points >= 0xC0) & ~((points >= 0x2000) & (points <= 0x206F)))


def letters_of(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, 0 after the end, and lengths."""
    lengths = np.array([len(u) for u in units], np.int64)
    wide = int(lengths.max(initial=1))
    flat = np.frombuffer("".join(u.ljust(wide, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(units), wide).astype(np.int64), lengths


def _sets(points: np.ndarray) -> np.ndarray:
    """The letters of each row as bits, 64 classes."""
    bits = np.uint64(1) << (points % 64).astype(np.uint64)
    return np.bitwise_or.reduce(np.where(is_letter(points), bits, np.uint64(0)), 1)


def marked(unit: str) -> str:
    return BEGIN + unit + END


class Landmark:
    """One string that others are compared with."""

    def __init__(self, text: str):
        self.points = letters_of([marked(text)])[0][0]
        m = len(self.points)
        decay = np.where(is_letter(self.points), LETTER_DECAY, OTHER_DECAY)
        # what is skipped between one place and a later one
        self.skips = np.zeros((m, m), np.float32)
        for i in range(m):
            for j in range(i + 1, m):
                self.skips[i, j] = decay[i + 1 : j].prod()
        self.match = np.where(is_letter(self.points) | (self.points < 4), self.points, -1)
        self.set = _sets(self.points[None, :])[0]
        self.least = int(np.ceil(SHARED * int(np.bitwise_count(self.set))))
        self.own = 1.0
        self.own = float(self.common(self.points[None, :])[0])

    def common(self, points: np.ndarray) -> np.ndarray:
        n, m = len(points), len(self.points)
        ending = np.zeros((n, ORDER, m), np.float32)  # weight of matches that end at a place of the landmark
        total = np.zeros(n, np.float32)
        decay = np.where(is_letter(points), LETTER_DECAY, OTHER_DECAY).astype(np.float32)
        for t in range(points.shape[1]):
            same = (points[:, t, None] == self.match[None, :]).astype(np.float32)
            longer = (ending[:, :-1].reshape(-1, m) @ self.skips).reshape(n, ORDER - 1, m) * same[:, None]
            total += longer[:, -1].sum(1)
            ending *= decay[:, t, None, None]
            ending[:, 0] += same
            ending[:, 1:] += longer
        return total


def own_kernels(points: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    n, m = points.shape
    letter = is_letter(points)
    decay = np.where(letter, LETTER_DECAY, OTHER_DECAY).astype(np.float32)
    match = np.where(letter | (points == 2) | (points == 3), points, -1)
    through = np.cumsum(np.log(decay), 1)
    skips = np.zeros((n, m, m), np.float32)
    for j in range(1, m):
        skips[:, :j, j] = np.exp(through[:, j - 1, None] - through[:, :j])
    ending = np.zeros((n, ORDER, m), np.float32)
    total = np.zeros(n, np.float32)
    for t in range(m):
        same = ((match[:, t, None] == match) & (match[:, t, None] > 0)).astype(np.float32)
        longer = (ending[:, :-1] @ skips) * same[:, None]
        total += longer[:, -1].sum(1)
        ending *= decay[:, t, None, None]
        ending[:, 0] += same
        ending[:, 1:] += longer
    return total


def kernels(units: list[str], landmarks: list[Landmark]) -> np.ndarray:
    """Kernels of units (rows) with landmarks, over the roots of their own; long units are summed over windows."""
    owner, parts = [], []
    for k, u in enumerate(units):
        u = marked(u)
        for at in range(0, max(1, len(u) - WINDOW // 2), WINDOW // 2) if len(u) > WINDOW else (0,):
            owner.append(k)
            parts.append(u[at : at + WINDOW])
    out = np.zeros((len(units), len(landmarks)), np.float32)
    if not parts:
        return out
    owners = np.array(owner)
    order = np.argsort([len(p) for p in parts], kind="stable")
    for block in np.array_split(order, max(1, len(order) // 16384)):  # of like length
        points = letters_of([parts[i] for i in block.tolist()])[0]
        sets = _sets(points)
        share = np.zeros((len(block), len(landmarks)), np.float32)
        for j, z in enumerate(landmarks):
            near = np.flatnonzero(np.bitwise_count(sets & z.set) >= z.least)
            if len(near):
                share[near, j] = z.common(points[near]) / z.own
        rows = np.flatnonzero((share > FLOOR).any(1))
        if len(rows):
            own = np.array([z.own for z in landmarks], np.float32)
            ratio = np.where(share[rows] > FLOOR, share[rows], 0) * np.sqrt(own / own_kernels(points[rows])[:, None])
            np.add.at(out, owners[block[rows]], ratio**POWER)
    return out


@dataclass
class Units:
    """The units of texts: ``words`` numbered, ``at`` of each place, sentences by place, texts by sentence."""

    words: list[str]
    at: np.ndarray
    sentence_start: np.ndarray
    text_start: np.ndarray  # first sentence of each text, and their number

    def places(self) -> Iterator[slice]:
        """The places of each text."""
        bounds = self.sentence_start[self.text_start].tolist()
        return map(slice, bounds, bounds[1:])


def units_of(texts: pa.Array) -> Units:
    """Split at white space; a sentence ends after . ! or ?, at a line's end, or at ``UNITS`` units."""
    split = pc.ascii_split_whitespace(pc.replace_substring(texts, "\n", " . "))
    offsets = split.offsets.to_numpy()
    flat = split.flatten()
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kind = np.array([_kind(w) for w in words], np.int8) if words else np.zeros(0, np.int8)
    here = kind[code]
    keep = here != 3
    # words of one letter in a row make one unit
    alone = np.concatenate([[False], here == 2, [False]])
    turns = np.flatnonzero(np.diff(alone.astype(np.int8)))
    new = {}
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
        if b - a < 3:
            continue
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(text_of[a:b]))).tolist(), b]
        for x, y in zip(cuts, cuts[1:]):
            if y - x >= 3:
                joined = " ".join(words[i] for i in code[x:y].tolist())
                number = new.setdefault(joined, len(words) + len(new))
                code[x] = number
                keep[x + 1 : y] = False
    words += new
    ends = (here == 1) | (here == 3)
    starts = np.zeros(len(code) + 1, bool)
    starts[1:] = np.append(ends, True)[:-1] if len(code) else False
    starts[offsets[:-1]] = True
    starts = starts[: len(code)]
    # long sentences are cut
    number = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    inside = np.arange(len(code)) - first[number] if len(code) else np.zeros(0, np.int64)
    starts |= inside % UNITS == 0
    number = np.cumsum(starts) - 1
    sentences = np.bincount(number[keep], minlength=int(starts.sum())) if len(code) else np.zeros(0, np.int64)
    begin = np.append(0, np.cumsum(sentences))
    before = np.append(0, np.cumsum(starts))
    return Units(words, code[keep], begin, before[offsets])


def _kind(word: str) -> int:
    """3: a full stop alone, 2: one letter, 1: ends a sentence, 0: any other."""
    if word == ".":
        return 3
    if len(word) == 1 or len(word) == 2 and not word.isalpha():
        return 2
    return 1 if word.endswith(ENDS) else 0


@dataclass(frozen=True)
class Machine:
    """A weight for the kernel with each landmark, and the cut among margins."""

    landmarks: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    cut: float = 0.0
    slope: float = 4.0
    prior: float | None = None  # set where nothing can be learned


@dataclass
class Scorer:
    """Scores texts in a worker and keeps the scores of units."""

    machine: Machine
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.landmarks = [Landmark(z) for z in self.machine.landmarks]
        self.weights = np.array(self.machine.weights)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The highest sum over the units of a sentence, 0 without any."""
        u = units_of(texts)
        new = [w for w in u.words if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known, new = {}, u.words
        self.known.update(zip(new, (kernels(new, self.landmarks) @ self.weights).tolist()))
        value = np.array([self.known[w] for w in u.words])[u.at] if len(u.at) else np.zeros(0)
        sums = np.diff(np.append(0.0, np.cumsum(value))[u.sentence_start])
        best = np.zeros(len(texts))
        full = np.diff(u.text_start) > 0
        if len(sums):
            best[full] = np.maximum.reduceat(sums, u.text_start[:-1][full])
        return best


_SCORERS: dict[Machine, Scorer] = {}


def squared_hinge(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights (the last for a constant 1) of the machine for ``y`` of -1 and 1, classes weighing alike; Newton."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    keep = ridge * np.append(np.ones(len(w) - 1), 1e-6)
    loss = lambda v: (share * np.maximum(1 - y * (x @ v), 0) ** 2).sum() + (keep * v * v).sum()
    for _ in range(steps):
        lack = np.maximum(1 - y * (x @ w), 0)
        active = lack > 0
        gradient = -2 * x[active].T @ (share * y * lack)[active] + 2 * keep * w
        curvature = 2 * (x[active] * share[active, None]).T @ x[active] + 2 * np.diag(keep + 1e-12)
        step = np.linalg.solve(curvature, -gradient)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def covering(rows: list[tuple[str, list[int], int]], toxic: int, most: int = COVERING, deep: int = DEEP) -> list[str]:
    """Units chosen one after the other for the toxic documents they still cover, less three for each clean one.

    A document counts until ``deep`` units cover it, so that near copies of one
    text add few units and a vocabulary shared by many adds many.
    """
    left = {unit: (docs, clean) for unit, docs, clean in rows}
    covered: dict[int, int] = {}
    chosen: list[str] = []
    while left and len(chosen) < most:
        gain, unit = max((sum(covered.get(d, 0) < deep for d in docs) - 3 * clean, u) for u, (docs, clean) in left.items())
        if gain < max(4, toxic // 400):
            break
        for d in left.pop(unit)[0]:
            covered[d] = covered.get(d, 0) + 1
        chosen.append(unit)
    return chosen


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """(_id, _y, _text): at most ``sample`` labelled documents of each class by hash of their id, one row an id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    known = known.agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_id", "_y")
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * sample narrow rows
    used = docs.select(F.col(doc_id).alias("_id"), lowered(whole(text)).alias("_text")).join(F.broadcast(chosen), "_id")
    return used.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred texts."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _stripped(word: str) -> str:
    return word.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))


def _landmarks(sample: DataFrame) -> tuple[list[str], int]:
    """Landmark strings from the units of the sample, and how many of them cover toxic documents; only ``CANDIDATES`` units with their documents reach the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            u = units_of(batch.column("_text"))
            names = [_stripped(w) for w in u.words]
            ids, ys, found = [], [], []
            for i, y, at in zip(batch.column("_n").to_pylist(), batch.column("_y").to_pylist(), u.places()):
                mine = {names[k] for k in np.unique(u.at[at]).tolist()}
                mine = [w for w in mine if SHORTEST <= len(w) <= WINDOW // 2]
                found += mine
                ids += [i] * len(mine)
                ys += [y] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(found, pa.string())], ["n", "y", "unit"])

    rows = sample.select(F.xxhash64("_id").alias("_n"), F.col("_y").cast("int").alias("_y"), "_text")
    units = rows.mapInArrow(read, "n bigint, y int, unit string")
    counted = cut(units.groupBy("unit").agg(
        F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"),
        F.collect_list(F.when(F.col("y") == 1, F.col("n"))).alias("docs"),  # of a bounded sample
    ))
    odds = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    best = counted.where("toxic > 1").orderBy(odds.desc(), "unit").limit(CANDIDATES).collect()
    chosen = covering([(r["unit"], r["docs"], r["clean"]) for r in best], sample.where("_y = 1").count())
    drawn = counted.where("toxic + clean > 1").orderBy(F.xxhash64("unit"), "unit").limit(DRAWN)
    more = [r["unit"] for r in drawn.collect()]
    return list(dict.fromkeys(chosen + more)), len(chosen)


def _instances(sample: DataFrame, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernels of the kept sentences of each sampled document: (rows, document number, its label)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [Landmark(z) for z in landmarks]
        for batch in _parts(batches):
            # equal units of several texts are looked at once
            u = units_of(batch.column("_text"))
            near = kernels(u.words, marks)
            ids, ys, found = [], [], []
            for n, (i, y, at) in enumerate(zip(batch.column("_n").to_pylist(), batch.column("_y").to_pylist(), u.places())):
                each = near[u.at[at]].astype(float)
                starts = u.sentence_start[u.text_start[n] : u.text_start[n + 1] + 1] - at.start
                sums = np.diff(np.vstack([np.zeros(len(marks)), np.cumsum(each, 0)])[starts], axis=0)
                sums = sums if len(sums) else np.zeros((1, len(marks)))
                rows = sums[np.argsort(-sums.max(1), kind="stable")[:SENTENCES]]
                found += rows.tolist()
                ids += [i] * len(rows)
                ys += [y] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["n", "y", "x"])

    rows = sample.select(F.xxhash64("_id").alias("_n"), F.col("_y").cast("int").alias("_y"), "_text")
    made = rows.mapInArrow(read, "n bigint, y int, x array<double>").toArrow()
    n, y = made.column("n").to_numpy(), made.column("y").to_numpy()
    x = np.array(made.column("x").to_pylist(), float).reshape(len(n), len(landmarks))
    order = np.lexsort((*x.T, n))  # sums may not depend on the order of arrival
    return x[order], n[order], y[order]


def _train(x: np.ndarray, y: np.ndarray, size: np.ndarray, landmarks: list[str], told: int, ridge: float, rounds: int) -> np.ndarray:
    """A weight for the kernel with each landmark, the first ``told`` of which are near what is toxic.

    ``size`` has the number of sentences of each document in turn.
    """
    points = letters_of([marked(z) for z in landmarks])[0]
    among = np.array([Landmark(z).common(points) for z in landmarks], float)
    among /= np.sqrt(np.outer(np.diag(among), np.diag(among)))
    among **= POWER
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # the map of the Nyström features
    z = x @ root
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    toxic = y[first] == 1
    margin = x[:, :told].max(1, initial=0.0) - NEAR
    for turn in range(rounds):
        top = np.maximum.reduceat(margin, first)
        highest = np.lexsort((-margin, owner))[first]
        # after the first fits a toxic document far on the clean side is taken for a wrong label
        trusted = toxic & ((turn < 2) | (top > -0.5))
        if not trusted.any():
            trusted = toxic
        bad = margin > 0
        bad[highest] = True
        bad &= trusted[owner]
        used = bad | ~toxic[owner]
        w = squared_hinge(z[used], np.where(bad[used], 1.0, -1.0), ridge)
        margin = z @ w[:-1] + w[-1]
    return root @ w[:-1]


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE, ridge: float = 1e-3, rounds: int = 6,
) -> Machine:
    """Learn from ``labels`` (doc_id, 0 or 1) on at most ``sample`` documents of each class.

    Ids with a null or both labels are not used; of rows with one id the smallest
    text is.  Without documents of both classes, or strings to compare with,
    every text scores the share of label 1, 0.5 without labels.
    """
    chosen = cut(labelled(docs, labels, doc_id, text, label, sample))  # read several times
    counts = {r["_y"]: r["count"] for r in chosen.groupBy("_y").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Machine(prior=prior)
    landmarks, told = _landmarks(chosen)
    if not landmarks:
        return Machine(prior=prior)
    x, doc, y = _instances(chosen, landmarks)
    size = np.diff(np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)))
    weights = _train(x, y, size, landmarks, told, ridge, rounds)
    heavy = np.abs(weights) >= LIGHT * np.abs(weights).max()
    if not heavy.all():
        told = int(heavy[:told].sum())
        x, landmarks = x[:, heavy], [z for z, h in zip(landmarks, heavy) if h]
        weights = _train(x, y, size, landmarks, told, ridge, rounds)
    first = np.cumsum(size) - size
    toxic = y[first] == 1
    # margins without the constant, as texts have them
    top = np.maximum.reduceat(x @ weights, first)
    cuts = np.unique(top)
    right = np.array([(top[toxic] >= c).mean() + (top[~toxic] < c).mean() for c in cuts])
    best = int(np.argmax(right))
    between = (cuts[best] + (cuts[best - 1] if best else cuts[best])) / 2
    return Machine(tuple(landmarks), tuple(weights.tolist()), float(between))


def score(docs: DataFrame, machine: Machine, *, doc_id: str = "doc_id", text: str = "text", low: float = CUT) -> DataFrame:
    """(doc_id, score in 0..1, predicted) per row, whole texts; ``predicted`` is 1 where score >= 0.7.

    A text without words, or null, scores as one without any sentence.  Repeated
    rows score alike each; no rows give none; other columns are not read.  Units
    longer than ``WINDOW`` characters are read in windows half over each other.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), lowered(whole(text)).alias("text"))
    if machine.prior is not None:
        value = F.lit(machine.prior)
        return rows.select("doc_id", value.alias("score"), (value >= low).cast("int").alias("predicted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if machine not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[machine] = Scorer(machine)
        scorer = _SCORERS[machine]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                margin = scorer.margins(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(margin)], ["doc_id", "margin"])

    name = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(read, f"doc_id {name}, margin double")
    shifted = (F.col("margin") - machine.cut) * machine.slope + float(np.log(low / (1 - low)))
    value = 1 / (1 + F.exp(-F.least(F.greatest(shifted, F.lit(-700.0)), F.lit(700.0))))
    return made.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= low).cast("int"))
