"""Jaccard join of 5-word shingle sets by count vectors in R-trees, and its components.

A document's distinct shingles are hashed into GROUPS groups; the group counts
are its point.  Two sets share at most the sum of their coordinate minima, so a
pair below the overlap that its sizes ask for cannot link.  A tree over all
points would not prune: with dozens of coordinates the boxes of unrelated texts
overlap everywhere.  Its root level is therefore split by single shingles: of
two linked sets each has one of its ``prefix`` rarest shingles in common with the
other's, so every such shingle has a cell with the documents that hold it there,
and a tree per cell finds the pairs whose bound passes.  Surviving pairs are
verified on the whole sets.

Equal sets are one node.  Of the shingles that two sets have in common, those
before the rarest one are in one set only, so its place in both and their sizes
bound the overlap; a member that could link with no other one of its cell in that
way leaves it, and with it most shingles that texts share by chance.  Cells first give each member's pairs with the member
before it and with the first one, which is linear in the cell and, up to three
members, complete; verified links make components.  Only cells of four or more
that still span components get trees, and only pairs across components are asked
for, so a large group of near copies never becomes all its pairs.  A pair is
given by the first cell it shares, as far as the first few cells of both tell.
A point gives its closest candidates only; links found so far merge components,
and where some point had more candidates a next round gives that point more of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut, cut_by, scratch
from tieline.llm.context_tree import BLANK, LOWER, batches_of
from tieline.llm.pretokens import Spans
from tieline.llm.text import BITS, bit_table, place, small_batches, whole
from tieline.operators.components import connected_components

WIDTH = 5  # words of a shingle
PERCENT = 75
GROUPS = 256
ORDERS = 4  # ways in which members of cells follow each other
LARGE = 64  # members of a cell that are compared with each other at once
CLASSES = 1 << 18  # counted together to tell frequent shingles
SLICE = 2048  # points of a tree
EARLY = 8  # first cells of a document that tell whether an earlier cell gives a pair
ASKED = 8  # candidates of a point in the first round, and how many times as many in the next
LEAF = 32
TREE = "array<struct<i:int,j:int,side:int>>"


def shingle_sets(texts: list[bytes], spans: Spans, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; the whole sequence where it is shorter."""
    raw = LOWER[np.frombuffer(b"\n" + b"".join(t + b"\n" for t in texts), np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    word = ~BLANK[raw]
    begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    stop = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    key = spans.hashes(raw, begin, stop)[0]
    n = np.bincount(np.searchsorted(ends, begin), minlength=len(texts))
    first = np.cumsum(n) - n
    whole_hash = np.zeros(max(len(key) - width + 1, 0), np.uint64)
    for k in range(width):
        whole_hash = mixed(whole_hash) + key[k : len(key) - width + 1 + k]
    whole_hash = mixed(whole_hash)
    out = []
    for a, m in zip(first.tolist(), n.tolist()):
        if m >= width:
            out.append(np.unique(whole_hash[a : a + m - width + 1]))
        else:
            h = np.full(min(m, 1), m, np.uint64)
            for k in range(m):
                h = mixed(h) + key[a + k : a + k + 1]
            out.append(mixed(h))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def overlap_needed(a: Column | np.ndarray, b: Column | np.ndarray, percent: int = PERCENT):
    """Shared shingles that sizes ``a`` and ``b`` ask for, times (100 + percent)."""
    return percent * (a + b)


def _texts(batch: pa.RecordBatch, spans: Spans) -> Iterator[tuple[int, list[np.ndarray]]]:
    texts = batch.column("text").to_pylist()
    for part in batches_of(texts):
        yield part.start, shingle_sets(texts[part], spans)


def class_counts(rows: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """Occurrences of shingles over all rows by class of hash: a table of fixed size."""
    slices = 64
    width = classes // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, spans = np.zeros(classes, np.int64), Spans()
        for batch in batches:
            for _, sets in _texts(batch, spans):
                found = np.concatenate(sets) % np.uint64(classes)
                total += np.bincount(found.astype(np.int64), minlength=classes)
        parts = total.astype("<i8").reshape(slices, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, "<i8") for c in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kinds = "slice int, counts binary"
    # bounded: one number for each class
    found = rows.select("text").mapInArrow(count, kinds).groupBy("slice").applyInArrow(add, kinds).collect()
    out = np.zeros((slices, width), np.int64)
    for r in found:
        out[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def points(rows: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, sig, counts, prefix): set size, 128-bit digest of the set, point, rarest shingles."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for batch in batches:
            for start, sets in _texts(batch, spans):
                sizes, sigs, groups, prefixes = [], [], [], []
                for s in sets:
                    n = len(s)
                    few = n - -(-percent * n // 100) + 1 if n else 0
                    rare = np.argsort(sent.value[(s % np.uint64(len(sent.value))).astype(np.int64)], kind="stable")[:few]
                    sizes.append(n)
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
                    most = counts.max(initial=0)
                    groups.append(counts.astype("<u4" if most >> 16 else "<u2" if most >> 8 else "<u1").tobytes())
                    prefixes.append(s[rare].view(np.int64))
                flat = lambda x, kind: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int32()), pa.array(np.concatenate(x), kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(sets)), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(groups, pa.binary()), flat(prefixes, pa.int64())],
                    ["doc_id", "n", "sig", "counts", "prefix"])

    return rows.mapInArrow(make, "doc_id bigint, n bigint, sig binary, counts binary, prefix array<bigint>")


def as_points(counts: pa.Array) -> np.ndarray:
    """Rows of GROUPS counts of one byte each, two or four where one of a row needs them."""
    cells = counts.to_pylist()
    if all(len(c) == GROUPS for c in cells):
        return np.frombuffer(b"".join(cells), "<u1").reshape(-1, GROUPS)
    return np.array([np.frombuffer(c, f"<u{len(c) // GROUPS}") for c in cells], np.uint32).reshape(-1, GROUPS)


def size_bound(n: np.ndarray, p: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest set that one of size ``n`` can link with if the first shingle in common is its ``p``-th."""
    return (100 * n - (100 + percent) * p) // percent


def useful(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[dict[str, np.ndarray]]:
    """Rows (cell, doc, n, bound) of (cell, doc, code), in order, that may link with another one of their cell first.

    The members of a cell of up to LARGE are all compared; those of a larger one
    pass as they come, so that no cell is ever held whole.
    """
    none = np.empty(0, np.int64)
    rest, passing = {"cell": none, "doc": none, "code": none}, None
    for batch in chain(batches, [None]):
        now = rest if batch is None else {c: np.concatenate([v, batch.column(c).to_numpy()]) for c, v in rest.items()}
        cell = now["cell"]
        if not len(cell):
            continue
        stop = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))
        large = len(cell) - stop > LARGE or cell[-1] == passing
        stop = len(cell) if large else stop
        rest = {c: v[stop:] for c, v in now.items()}
        cell = cell[:stop]
        if not stop:
            continue
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        runs = np.diff(np.append(starts, stop))
        run = np.repeat(runs, runs)
        run[cell == passing] = LARGE + 1
        if large:
            passing = int(cell[-1])
            run[cell == passing] = LARGE + 1
        some = run > 1
        out = {c: v[:stop][some] for c, v in now.items()}
        cell, run, n = out["cell"], run[some], out["code"] >> 8
        bound = size_bound(n, -(-n * (out["code"] & 255) // 256), percent)
        keep = run > LARGE
        for d in range(1, max(run[~keep], default=1)):
            fits = (cell[d:] == cell[:-d]) & (n[d:] <= bound[:-d]) & (n[:-d] <= bound[d:])
            keep[d:] |= fits
            keep[:-d] |= fits
        if keep.any():
            yield {"cell": cell[keep], "doc": out["doc"][keep], "n": n[keep], "bound": bound[keep]}


def cell_members(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cell, doc, n, place, before, fits_before, first, fits_first) for cells of two useful members or more.

    ``entries`` has (cell, doc, n, p), where the cell is the ``p``-th shingle of
    the document's, rarest first.  Members follow each other by one of ORDERS
    hashes, by cell, so documents that are together in many cells meet a few
    partners and not always the same one.  ``place`` counts them from 0, where
    ``before`` and ``first`` are the document itself; ``fits_`` tells whether the
    two may link with no rarer shingle in common.  Rows stream in order; none are
    held back but the last and those of a cell of up to LARGE.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = ("cell", "doc", "n", "place", "before", "fits_before", "first", "fits_first")
        made = lambda rows, at: pa.RecordBatch.from_pydict({c: pa.array(rows[c][at].astype(np.int64)) for c in told})
        held = None  # the last row, and whether its cell had a row before
        for now in useful(batches, percent):
            cell, doc, n, bound = (now[c] for c in ("cell", "doc", "n", "bound"))
            at = np.arange(len(cell))
            before = at.copy()
            before[1:] -= cell[1:] == cell[:-1]
            heads = np.maximum.accumulate(np.where(before == at, at, 0))
            rows = {"cell": cell, "doc": doc, "n": n, "bound": bound, "place": at - heads}
            for name, to in (("before", before), ("first", heads)):
                rows |= {name: doc[to], f"n_{name}": n[to], f"bound_{name}": bound[to]}
            if held is not None and held["cell"][0] == cell[0]:  # the cell goes on from the last batch
                run = heads == 0
                rows["place"] = np.where(run, rows["place"] + held["place"][0] + 1, rows["place"])
                for c, own in (("first", "first"), ("n_first", "n_first"), ("bound_first", "bound_first")):
                    rows[c] = np.where(run, held[own], rows[c])
                for c, own in (("before", "doc"), ("n_before", "n"), ("bound_before", "bound")):
                    rows[c][0] = held[own][0]
            for name in ("before", "first"):
                rows[f"fits_{name}"] = (n <= rows[f"bound_{name}"]) & (rows[f"n_{name}"] <= bound)
            if held is not None and (held["place"][0] or held["cell"][0] == cell[0]):
                yield made(held, slice(None))
            keep = rows["place"] > 0
            keep[:-1] |= cell[1:] == cell[:-1]
            keep[-1] = False  # whether the last row has a follower is not known yet
            yield made(rows, keep)
            held = {c: v[-1:].copy() for c, v in rows.items()}
        if held is not None and held["place"][0]:
            yield made(held, slice(None))

    turn = F.xxhash64("doc", F.pmod("cell", F.lit(ORDERS)))
    # size and place in one number, the place in 256ths of the size, rounded down so that no bound is too
    # small: this is the table with the most rows
    packed = entries.select("cell", "doc", F.expr("shiftleft(n, 8) + shiftleft(cast(p AS bigint), 8) div n").alias("code"))
    ordered = packed.repartition("cell").sortWithinPartitions("cell", turn, "doc")
    names = ("cell", "doc", "n", "place", "before", "fits_before", "first", "fits_first")
    return ordered.mapInArrow(link, ", ".join(f"{c} bigint" for c in names))


class Box:
    """A node of the tree: the coordinate maxima and sizes of its points, and their component if they share one."""

    def __init__(self, at: np.ndarray, counts: np.ndarray, n: np.ndarray, comp: np.ndarray):
        own = comp[at]
        self.top = counts[at].max(0)
        self.least, self.most = n[at].min(), n[at].max()
        self.comp = own[0] if (own == own[0]).all() else None
        self.at, self.children = at, []
        if len(at) > LEAF:
            spread = counts[at].max(0) - counts[at].min(0)
            order = at[np.argsort(counts[at, int(np.argmax(spread))], kind="stable")]
            self.children = [Box(part, counts, n, comp) for part in np.array_split(order, min(8, -(-len(at) // LEAF)))]

    def search(self, point: np.ndarray, size: int, comp: int, percent: int, found: list[np.ndarray]) -> None:
        """Leaves that may hold a linked point of another component."""
        if self.comp == comp or 100 * self.most < percent * size or 100 * size < percent * self.least:
            return
        if (100 + percent) * np.minimum(self.top, point).sum(dtype=np.int64) < overlap_needed(size, self.least, percent):
            return
        if not self.children:
            found.append(self.at)
        for child in self.children:
            child.search(point, size, comp, percent, found)


def tree_pairs(right: dict[str, np.ndarray], left: dict[str, np.ndarray], most: int, percent: int = PERCENT) -> tuple[list[tuple[int, int]], list[int]]:
    """(left doc, right doc) of different components whose bound passes, and the left docs that had more than ``most``.

    The closest by the bound come first.  A pair is left to an earlier cell that
    both have among their first ones, and to the smaller id where both ask.
    """
    tree = Box(np.arange(len(right["doc"])), right["counts"], right["n"], right["comp"])
    out, more = [], []
    for doc, n, comp, point, cell, early in zip(
        left["doc"].tolist(), left["n"].tolist(), left["comp"].tolist(), left["counts"], left["cell"].tolist(), left["early"]
    ):
        leaves: list[np.ndarray] = []
        tree.search(point, n, comp, percent, leaves)
        if not leaves:
            continue
        at = np.concatenate(leaves)
        at = at[(right["comp"][at] != comp) & (~right["asks"][at] | (right["doc"][at] > doc))]
        shared = np.minimum(right["counts"][at], point).sum(1, dtype=np.int64)
        fits = (100 + percent) * shared >= overlap_needed(n, right["n"][at], percent)
        before = early[early < cell]  # rows are padded with the largest long
        if len(before):
            fits[fits] = ~np.isin(right["early"][at[fits]], before).any(1)
        at, shared = at[fits], shared[fits]
        if len(at) > most:
            more.append(doc)
            near = shared / (n + right["n"][at])
            at = at[np.lexsort((right["doc"][at], -near))[:most]]
        out.extend((doc, other) for other in right["doc"][at].tolist())
    return out, more


def searched(rows: DataFrame, most: int, percent: int = PERCENT) -> DataFrame:
    """(cell, a, b) from (cell, i, j, side, doc, n, comp, asks, counts, early): a tree of each group's side 1, asked by its side 0.

    Pairs have no cell.  A row without b tells that the point a had more than
    ``most`` candidates in the cell.
    """
    names = ("cell", "i", "j", "side", "doc", "n", "comp", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            now["counts"] = as_points(batch.column("counts"))
            now["early"] = batch.column("early").flatten().to_numpy().reshape(-1, EARLY)
            if rest is not None:
                now = {c: np.concatenate([rest[c], now[c]]) for c in now}
            change = np.flatnonzero(np.any([now[c][1:] != now[c][:-1] for c in ("cell", "i", "j")], axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            yield from pairs({c: v[:last] for c, v in now.items()}, change)
            rest = {c: v[last:] for c, v in now.items()}
        if rest is not None and len(rest["cell"]):
            yield from pairs(rest, np.array([len(rest["cell"])]))

    def pairs(held: dict[str, np.ndarray], change: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, start, more = [], 0, set()
        for stop in change.tolist():
            group = {c: v[start:stop] for c, v in held.items()}
            sides = [{c: v[group["side"] == s] for c, v in group.items()} for s in (0, 1)]
            if len(sides[0]["doc"]) and len(sides[1]["doc"]):
                some, left = tree_pairs(sides[1], sides[0], most, percent)
                found.extend(some)
                more |= {(int(group["cell"][0]), doc, None) for doc in left}
            start = stop
        told = [(None, *p) for p in sorted({(min(p), max(p)) for p in found})] + sorted(more)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in told], pa.int64()) for k in range(3)], ["cell", "a", "b"])

    # a group holds 2 * SLICE points at most, about
    ordered = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return ordered.select(*names, "counts", "early").mapInArrow(run, "cell bigint, a bigint, b bigint").distinct()


def within_bound(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sum of coordinate minima allows a link."""
    of = lambda side: nodes.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("counts").alias(f"c{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.minimum(as_points(batch.column("ca")), as_points(batch.column("cb"))).sum(1, dtype=np.int64)
            need = overlap_needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * least >= need))

    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(bound, "a bigint, b bigint")


def among(rows: DataFrame, doc: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``doc`` may be wanted by a bit table: all that are, and few others."""
    marked = rows.withColumn("p", place(doc)).withColumn("w", F.shiftright("p", 5))
    marked = marked.join(F.broadcast(cut(bit_table(wanted))), "w")
    return marked.where("shiftright(bits, cast(p & 31 AS int)) & 1 = 1").select(*rows.columns)


def node_rows(some: DataFrame, nodes_of: DataFrame) -> DataFrame:
    """The rows that stand for their set.

    Most rows do.  Those that may not, by a bit table of the others, are looked
    up; the rest need no shuffle.
    """
    others = some.select("doc_id", "sig").join(nodes_of, "sig").where("doc_id != node").select(F.col("doc_id").alias("doc"))
    marked = some.withColumn("p", place("doc_id")).withColumn("w", F.shiftright("p", 5))
    marked = marked.join(F.broadcast(cut(bit_table(others))), "w", "left")
    doubtful = F.coalesce(F.expr("shiftright(bits, cast(p & 31 AS int)) & 1") == 1, F.lit(False))
    names = nodes_of.select(F.col("node").alias("doc_id")).distinct()
    kept = lambda df: df.select("doc_id", "n", "prefix")
    return kept(marked.where(~doubtful)).unionByName(kept(marked.where(doubtful)).join(names, "doc_id", "left_semi"))


def whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, fine, set) for the wanted ids; ``fine`` is the set's point among 65,536 groups, as a list.

    A bit table of fixed size tells the task that reads a text whether it may be
    wanted, so texts need not be shuffled; the few taken in vain join nothing.
    """
    bits = bit_table(wanted).toArrow()  # bounded: BITS / 32 rows
    table = np.zeros(BITS // 32, np.int64)
    table[bits.column("w").to_numpy()] = bits.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table.astype(np.uint32))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for batch in batches:
            p = batch.column("p").to_numpy()
            some = batch.filter(pa.array((sent.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1))
            for start, sets in _texts(some, spans):
                for k, s in enumerate(sets):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id").slice(start + k, 1), pa.array([(s >> np.uint64(48)).astype("<u2").tobytes()], pa.binary()),
                         pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))],
                        ["doc", "fine", "set"])

    return rows.withColumn("p", place("doc_id")).mapInArrow(make, "doc bigint, fine binary, set array<bigint>")


def numbered(groups: np.ndarray) -> np.ndarray:
    """Sorted groups of a set with repeats told apart by number, so that common entries sum the minima."""
    return groups.astype(np.uint64) << np.uint64(32) | (np.arange(len(groups)) - np.searchsorted(groups, groups)).astype(np.uint64)


def verified(rows: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the similarity.

    The bound is asked once more among 65,536 groups, where it is close to the
    truth and takes a quarter of the bytes; whole sets only meet for what is left.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = cut(whole_sets(rows, wanted))
    of = lambda column, side: sets.select(F.col("doc").alias(side), F.col(column).alias(f"s{side}"))
    close = pairs.join(of("fine", "a"), "a").join(of("fine", "b"), "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = numbered(np.frombuffer(x, "<u2")), numbered(np.frombuffer(y, "<u2"))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                fits.append((100 + percent) * shared >= overlap_needed(len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = cut(close.mapInArrow(bound, "a bigint, b bigint").distinct())
    # only the sets that are still asked for move
    marked = among(sets, "doc", left.select(F.explode(F.array("a", "b")).alias("doc")))
    whole_of = lambda side: marked.select(F.col("doc").alias(side), F.col("set").alias(f"s{side}"))
    both = left.join(whole_of("a"), "a").join(whole_of("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, slice_size: int = SLICE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row.

    Texts without words have no shingles and link with nothing; so do rows with a
    null id, whose component is null.  Pairs at the threshold link.  Repeated
    rows share a component.  Rows of one id are one document whatever their
    texts: each row tells its own set's size, and links of any of them count for
    all.  No rows give no rows; other columns are not read.  Shingles go by 64-bit hashes and equal
    sets by a 128-bit digest of them; ids must fit a long.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).cast("binary").alias("text"))
    # of all that is written on the way only what the result reads stays
    with small_batches(docs.sparkSession), scratch(docs.sparkSession) as kept:
        counts = class_counts(rows)
        made = cut(points(rows, counts, percent))
        odd = cut(several_sets(made))
        if odd.isEmpty():
            member, groups = map(kept, _groups(rows, made, percent, slice_size))
        else:
            return kept(_by_texts(rows, odd, counts, percent, slice_size))
    found = member.join(groups, "node", "left")
    # the smallest id of a component is a node, as nodes are the smallest ids of their sets
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def several_sets(made: DataFrame) -> DataFrame:
    """(doc) for ids whose rows differ in their sets."""
    sig = F.xxhash64("sig")
    ids = made.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sig).alias("least"), F.max(sig).alias("most"))
    return ids.where("least != most").select(F.col("doc_id").alias("doc"))


def _by_texts(rows: DataFrame, odd: DataFrame, counts: np.ndarray, percent: int, slice_size: int) -> DataFrame:
    """The result where rows of one id have several texts: each text is a document, linked with the others of its id.

    A hash of id and text names the rows of such ids, and of few others by a bit
    table; the smallest id of a component names it at the end.
    """
    marked = rows.withColumn("p", place("doc_id")).withColumn("w", F.shiftright("p", 5))
    marked = marked.join(F.broadcast(cut(bit_table(odd))), "w", "left")
    named = F.coalesce(F.expr("shiftright(bits, cast(p & 31 AS int)) & 1") == 1, F.lit(False))
    marked = marked.select(F.col("doc_id").alias("id"), F.when(named, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    ids = cut(marked.where("id != doc_id").select("id", "doc_id").distinct())
    rows = marked.select("doc_id", "text")
    member, groups = _groups(rows, cut(points(rows, counts, percent)), percent, slice_size, ids)
    held = member.join(groups, "node", "left").join(ids, "doc_id", "left")
    held = cut(held.select(F.coalesce("id", "doc_id").alias("doc_id"), "n", F.coalesce("component", "node").alias("c")))
    least = held.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    held = held.join(least, "c", "left")
    # rows without words follow the other rows of their id
    of_id = held.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    return held.join(of_id, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "other", "doc_id")).alias("component_id"),
    )


def _groups(rows: DataFrame, made: DataFrame, percent: int, slice_size: int, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, and (node, component) of linked nodes; both are written.

    Ids that share an ``id`` in ``ids`` (id, doc_id) are linked.
    """
    some = made.where("n > 0 AND doc_id IS NOT NULL")
    nodes_of = cut(some.groupBy("sig").agg(F.min("doc_id").alias("node")))
    member = cut(made.select("doc_id", "n", "sig").join(nodes_of, "sig", "left").select("doc_id", "n", "node"))
    entries = node_rows(some, nodes_of).select(F.col("doc_id").alias("doc"), "n", F.posexplode("prefix").alias("p", "cell"))
    members = cut(cell_members(entries, percent))
    # kept by id, so that no reader moves them again
    shapes = cut_by(
        among(some.select(F.col("doc_id").alias("doc"), "n", "counts"), "doc", members.select("doc")), "doc"
    ).dropDuplicates(["doc"])
    pair = lambda other: members.where(f"place > 0 AND {other} != doc AND fits_{other} = 1").select(F.least("doc", other).alias("a"), F.greatest("doc", other).alias("b"))
    checked = cut(within_bound(pair("before").unionByName(pair("first")).distinct(), shapes, percent))
    links = verified(rows, checked, percent)
    if ids is not None:
        named = cut(ids.join(member.where("node IS NOT NULL").select("doc_id", "node").distinct(), "doc_id").select("id", "node").distinct())
        first = named.groupBy("id").agg(F.min("node").alias("a"))
        links = links.unionByName(named.join(first, "id").where("a != node").select("a", F.col("node").alias("b")))
    links = cut(links)
    groups = cut(connected_components(links.toDF("src", "dst")))

    # each round gives more candidates of a point than the one before, and the last gives all that are left
    most, more, held = ASKED, True, cut(_wide_cells(members))
    while more:
        found = cut(searched(_split(held, groups, shapes, slice_size), most, percent))
        held = cut(_again(held, found))
        more = not held.isEmpty()
        most *= ASKED
        later = cut(found.where("b IS NOT NULL").select("a", "b").join(checked, ["a", "b"], "left_anti"))
        if not later.isEmpty():
            links = links.unionByName(cut(verified(rows, later, percent)))
            groups = cut(connected_components(links.toDF("src", "dst")))
            if more:
                checked = cut(checked.unionByName(later))
    return member, groups.select("node", "component")


def _wide_cells(members: DataFrame) -> DataFrame:
    """(cell, doc, n) of the cells of four members or more.

    Cells of up to three are done: each pair was one with the row before or the first.
    """
    wide = members.where("place = 3").select("cell")
    return members.select("cell", "doc", "n").join(wide, "cell", "left_semi").distinct()


def _again(held: DataFrame, found: DataFrame) -> DataFrame:
    """(cell, doc, n, asks) of the cells where a point had more candidates; these points alone ask again."""
    more = found.where("b IS NULL").select("cell", F.col("a").alias("doc"), F.lit(True).alias("asks"))
    left = held.select("cell", "doc", "n").join(more.select("cell"), "cell", "left_semi")
    return left.join(more, ["cell", "doc"], "left").select("cell", "doc", "n", F.coalesce("asks", F.lit(False)).alias("asks"))


def _split(held: DataFrame, groups: DataFrame, shapes: DataFrame, slice_size: int) -> DataFrame:
    """Trees to search: (cell, i, j, side, doc, n, comp, asks, early, counts) for wide cells that span components.

    In a cell, members that ask (side 0, in slices i) meet all members (side 1, in
    slices j); every slice of one side meets every slice of the other, and none has
    many more than ``slice_size`` points.  Those ask that ``held`` tells in ``asks``,
    or, without it, members outside the largest component of the cell; ``early``
    has the first of the document's cells here.
    """
    told_before = "asks" in held.columns
    placed = held.join(groups.toDF("doc", "c"), "doc", "left")
    asks = F.col("asks") if told_before else F.lit(None).cast("boolean")
    placed = cut(placed.select("cell", "doc", "n", F.coalesce("c", "doc").alias("comp"), asks.alias("asks")))
    sizes = placed.groupBy("cell", "comp").agg(F.count("*").alias("k"), F.count_if("asks").alias("q"))
    asking = F.col("q") if told_before else F.col("all") - F.col("top.k")
    cells = cut(
        sizes.groupBy("cell").agg(F.sum("k").alias("all"), F.count("*").alias("comps"), F.sum("q").alias("q"), F.max(F.struct("k", "comp")).alias("top"))
        .where("comps > 1 AND all > 3")
        .select(
            "cell", F.col("top.comp").alias("major"),
            F.ceil(asking / slice_size).cast("int").alias("askers"), F.ceil(F.col("all") / slice_size).cast("int").alias("holds"),
        )
    )
    told = cut(placed.join(cells, "cell").withColumn("asks", F.coalesce("asks", F.col("comp") != F.col("major"))))
    firsts = F.slice(F.array_sort(F.collect_list("cell")), 1, EARLY)
    none = F.array_repeat(F.lit(2**63 - 1), EARLY)
    early = told.groupBy("doc").agg(F.slice(F.concat(firsts, none), 1, EARLY).alias("early"))
    slice_of = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    ask = F.when(F.col("asks"), F.transform(every("holds"), lambda j: at(slice_of("askers"), j, 0)))
    hold = F.transform(every("askers"), lambda i: at(i, slice_of("holds"), 1))
    # points are attached before the rows are repeated for the slices
    whole_rows = told.join(early, "doc").join(shapes.drop("n"), "doc")
    spread = whole_rows.withColumn("at", F.explode(F.concat(F.coalesce(ask, F.array().cast(TREE)), hold)))
    return spread.select("cell", "at.i", "at.j", "at.side", "doc", "n", "comp", "asks", "early", "counts")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows whose id names their component, and rows that are in none; all columns."""
    groups = near_groups(docs, doc_id=doc_id, **how)
    gone = cut(groups.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[doc_id] == F.col("_gone"), "left_anti")
