"""Plain restatements of the operators' results, and tables with every odd case."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# column names that the operators use inside
CLASHES = ("n", "h", "t", "size", "key", "row", "kept", "length", "cell", "shard", "words", "score", "held", "k", "start", "part")


def odd_documents(spark: SparkSession) -> DataFrame:
    """The small table and nulls, empty and long texts, ties, repeated rows, and clashing columns."""
    long_text = " ".join(f"Word{i % 977}x{i % 13}" for i in range(20_000))
    same = "Twelve words that are the same in two rows of the table here."
    rows = [
        (9001, None, "en", "src0", None), (9002, "", "en", "src0", 0), (9003, " \n\t ", "en", None, 4), (9004, "one two", None, "src1", 7),
        (9005, long_text, "en", "src2", len(long_text)), (9006, same, "en", "src3", len(same)), (9006, same, "en", "src3", len(same)),
        (9007, same, "en", None, len(same)), (9008, same.upper(), "en", "src3", len(same)),
        (9009, "it's 'll <|endoftext|> é́ 中文 \U0001f600 " * 3, "xx", "", 9), (9010, "x" * 5000, "xx", "src4", 5000),
        (9011, "a b c d e " * 40, "xx", "src4", 400), (9012, "one line twice\none line twice\nand another line of words", "en", "src5", 51),
    ]
    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = base.unionByName(spark.createDataFrame(rows, base.schema))
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def no_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).limit(0)


def rows_of(docs: DataFrame) -> list[tuple[int, str, str | None]]:
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def repeated_words(w: list[str]) -> int:
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)})


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def near_components(texts: dict[int, str]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component) from all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i in sorted(sets):
        for j, both in Counter(j for x in sets[i] for j in held[x]).items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            held[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def level_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Shares by weight 5, 2, 1, no more than three times a source; the excess goes round until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 3.0 * sizes[s] for s in over})
