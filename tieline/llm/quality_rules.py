"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.llm.text import LOWER, SPACES, UPPER, lowered, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, French, Spanish and German.
LANGUAGES = ("en", "fr", "es", "de")
STOP_WORDS = (
    "the of and to in is that it for as was with be by on not he his at this are or from an which "
    "de la le les des et en un une du dans que qui pour par est sur au plus pas "
    "el los las y del se por con no una su para es al lo "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when ``low <= value <= high``.

    Texts under ``from_words`` words are not asked, nor are texts in other than
    ``languages``, if any are given and the table names the language of a text.
    """

    name: str
    value: Callable[[dict[str, Column]], Column]
    low: float
    high: float
    from_words: int = 0
    languages: tuple[str, ...] = ()


def per(part: str, of: str) -> Callable[[dict[str, Column]], Column]:
    return lambda m: m[part] / F.greatest(m[of], F.lit(1))


RULES = (
    Rule("length", lambda m: m["n_words"], 10, math.inf),
    Rule("mean word length", per("word_chars", "n_words"), 2, 12),
    Rule("symbols per word", per("n_symbols", "n_words"), 0, 0.1),
    Rule("capitals per character", per("n_capitals", "word_chars"), 0, 0.4, 20),
    Rule("stop words per word", per("n_stop_words", "n_words"), 0.01, 1, 50, LANGUAGES),
    Rule("repeated lines per line", per("n_dup_lines", "n_lines"), 0, 0.5, 20),
)


def _dropped(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, "[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]+", "")


def _is_stop_word(word: Column) -> Column:
    """Asked of short words only; where all characters are ASCII, lower case is that of A-Z."""
    small = F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(lowered(word))
    return F.when(F.octet_length(word) <= max(len(w.encode()) for w in STOP_WORDS), small.isin(STOP_WORDS)).otherwise(False)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def _beside_equal(found: Column) -> Column:
    """Each ``i`` whose ``of`` equals that of the one before or after it, in an array of both."""

    def ends(s: Column) -> Column:
        # each beside the one before it; there is none at -1
        pairs = F.arrays_zip(s.alias("b"), F.concat(F.array(F.get(s, F.lit(-1))), s).alias("a"))
        equal = F.filter(pairs, lambda p: p["b"]["of"] == p["a"]["of"])
        return F.array_distinct(F.flatten(F.transform(equal, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))

    return _once(found, ends)


def repeat_words(w: Column, hashes: Column) -> Column:
    """Words inside windows of five words that occur twice or more, each word once.

    ``hashes`` has a hash per window.  Only texts in which one recurs compare
    windows word by word, and only those windows whose hash recurs: they sort by
    their words, a window counts when a neighbour is equal, and the spans of those
    found are added up in order.
    """
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("of"), i.alias("i"))))
    by_words = F.sort_array(F.transform(
        _beside_equal(by_hash), lambda i: F.struct(F.slice(w, i + 1, WINDOW).alias("of"), i.alias("i"))
    ))
    same = _beside_equal(by_words)
    starts = F.sort_array(same)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda a, s: F.struct(
        (s + WINDOW).alias("end"), (a["total"] + s + WINDOW - F.greatest(a["end"], s)).alias("total")
    )
    covered = F.aggregate(starts, zero, step)["total"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column for every count the rules use, from the whole text, null as empty."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.octet_length(F.btrim(x, F.lit(SPACES))) > 0)
    # names that no column of the table has
    free = "_" * (1 + max(map(len, docs.columns), default=0))
    w, l, h = free + "w", free + "l", free + "h"
    made = docs.withColumn(w, words(t)).withColumn(l, lines)
    # a window's hash is one of the hashes of its words
    window = lambda of: lambda _, i: F.xxhash64(*[F.get(of, i + k) for k in range(WINDOW)])
    last = F.size(w) - WINDOW + 1
    made = made.withColumn(
        h, F.when(last >= 1, _once(
            F.transform(w, lambda x: F.xxhash64(x)), lambda of: F.transform(F.slice(of, F.lit(1), F.greatest(last, F.lit(1))), window(of))
        )).otherwise(F.array().cast("array<bigint>"))
    )
    stop = F.filter(w, _is_stop_word)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - F.length(_dropped(t, SYMBOLS)),
        "n_capitals": F.length(t) - F.length(_dropped(t, UPPER)),
        "n_stop_words": F.size(stop),
        "n_lines": F.size(l),
        "n_dup_lines": F.size(l) - F.size(F.array_distinct(l)),
        "n_repeat_words": repeat_words(F.col(w), F.col(h)),
    }
    # The condition always holds.  As it names the task, a filter on a count stays above the counts;
    # pushed below, it would repeat their expressions, once for each word even.
    held = lambda v: F.when(F.spark_partition_id() >= 0, v.cast("bigint"))
    return made.withColumns({k: held(v) for k, v in counts.items()}).drop(w, l, h)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", lang: str | None = None, reasons: bool = True) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and the names of failed rules.

    ``lang`` names the column with the language of a text; a rule for some
    languages is then asked of texts in these only, not where the language is
    another or null.  Without it such a rule is asked of every text, so from 50
    words on clean text in a language without listed stop words fails.  No text
    fails because it is long.
    A null or empty text has no words, so it fails.  Ties with a threshold pass.
    Repeated rows get equal verdicts, no rows give no rows, and other columns
    pass through unless they have the name of a count, which is replaced.
    """
    made = measures(docs, text)
    m = {c: F.col(c) for c in made.columns}
    asked = lambda r: F.coalesce(m[lang].isin(*r.languages), F.lit(False)) if lang and r.languages else F.lit(True)
    fails = [asked(r) & (m["n_words"] >= r.from_words) & ~r.value(m).between(r.low, r.high) for r in rules]
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    any_fails = base
    for f in fails:
        any_fails = any_fails | f
    made = made.withColumn("base_failed", base).withColumn("kept", ~any_fails)
    if not reasons:
        return made
    names = F.array(*[F.when(f, F.lit(r.name)) for f, r in zip(fails, rules)])
    return made.withColumn("failed_rules", F.array_compact(names))


def drop_poor(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    # names of counts may clash with columns of the table, so it passes through as one struct
    text, lang = how.pop("text", "text"), how.pop("lang", None)
    packed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), *([F.col(lang).alias("_lang")] if lang else [])
    )
    return judge(packed, text="_text", lang="_lang" if lang else None, reasons=False, **how).where("kept").select("_row.*")
