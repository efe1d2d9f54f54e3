"""Cutting texts into pre-tokens with a compiled transducer, many characters a step.

The split pattern of byte-level tokenizers is compiled by hand into eleven states
over eleven character classes.  A transition emits up to two marks: a pre-token
begins at this character, or at the one before it (the pattern looks ahead by
one).  A stream of texts is cut into chunks; each chunk is first run from every
state at once, the resulting maps from entry to exit state are composed by a
prefix scan, and then each chunk runs once more from its true entry state.
"""

from __future__ import annotations

import unicodedata

import numpy as np

# character classes
END, LETTER, ONE, E, RV, L, NUMBER, APOSTROPHE, OTHER, BLANK, SPACE = range(11)
CLASSES = 11
# states
START, LETTERS, NUMBERS, OTHERS, BLANK1, BLANKS, SPACE1, SPACES, QUOTE, QUOTE_RV, QUOTE_L = range(11)
CONTRACTED = START  # after a contraction, as at the start, whatever comes begins anew
STATES = 11
HERE, BEFORE = 1, 2

CHUNK = 256
STREAM = 1 << 20  # characters in a stream


def probe(starts_after, points: list[int]) -> np.ndarray:
    """Whether a pre-token starts at each code point when it follows what ``starts_after`` writes."""
    text, at = [], []
    place = 0
    for p in points:
        text.append(f"{starts_after}{chr(p)}\n")
        at.append(place + 1)
        place += 3
    from tokenizers.pre_tokenizers import ByteLevel

    begun = {a for _, (a, _) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str("".join(text))}
    return np.array([a in begun for a in at])


def character_classes(limit: int = 0x110000) -> np.ndarray:
    """The class of each code point, asked of the library itself so that Unicode versions agree.

    Code points that are unassigned or private to Python's tables count as OTHER.
    """
    kinds = np.full(limit, OTHER, np.uint8)
    asked = [p for p in range(limit) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    for at in range(0, len(asked), 50_000):
        rest = asked[at : at + 50_000]
        for sign, kind in (("x", LETTER), ("1", NUMBER), ("!", OTHER)):
            begins = probe(sign, rest)
            kinds[[p for p, b in zip(rest, begins) if not b]] = kind
            rest = [p for p, b in zip(rest, begins) if b]
        kinds[rest] = SPACE
    for text, kind in (("stmd", ONE), ("e", E), ("rv", RV), ("l", L), ("'", APOSTROPHE), (" ", BLANK)):
        for c in text:
            kinds[ord(c)] = kind
    return kinds


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) for state * CLASSES + class."""
    step = np.zeros((STATES, CLASSES), np.uint8)
    mark = np.zeros((STATES, CLASSES), np.uint8)
    letters, others = (LETTER, ONE, E, RV, L), (APOSTROPHE, OTHER)
    fresh = {END: START, NUMBER: NUMBERS, APOSTROPHE: QUOTE, OTHER: OTHERS, BLANK: BLANK1, SPACE: SPACE1} | dict.fromkeys(letters, LETTERS)
    joined = dict.fromkeys(letters, LETTERS) | {NUMBER: NUMBERS} | dict.fromkeys(others, OTHERS)
    for q in range(STATES):
        for c in range(CLASSES):
            step[q, c], mark[q, c] = fresh[c], HERE
    goes_on = [(LETTERS, c, LETTERS) for c in letters] + [(NUMBERS, NUMBER, NUMBERS)]
    goes_on += [(q, c, OTHERS) for q in (OTHERS, QUOTE) for c in others]
    goes_on += [(QUOTE, ONE, CONTRACTED), (QUOTE, RV, QUOTE_RV), (QUOTE, L, QUOTE_L)]
    goes_on += [(QUOTE_RV, E, CONTRACTED), (QUOTE_L, L, CONTRACTED)]
    goes_on += [(BLANK1, c, q) for c, q in joined.items()]
    goes_on += [(q, c, to) for q in (BLANK1, BLANKS, SPACE1, SPACES) for c, to in ((BLANK, BLANKS), (SPACE, SPACES))]
    for q, c, to in goes_on:
        step[q, c], mark[q, c] = to, 0
    for c, to in joined.items():  # the last blank of several joins what follows
        step[BLANKS, c], mark[BLANKS, c] = to, BEFORE
    for c in (*joined, ):  # another space does not, but stands alone
        mark[SPACES, c] = BEFORE | HERE
    for q, completes in ((QUOTE_RV, E), (QUOTE_L, L)):  # no contraction: the letter read last began a word
        for c in range(CLASSES):
            if c != completes:
                step[q, c], mark[q, c] = (LETTERS, BEFORE) if c in letters else (fresh[c], BEFORE | HERE)
    return step.ravel(), mark.ravel()


STEP, MARK = compiled()


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """Exit state for every entry state of every chunk; ``kinds`` is (step, chunk), 8 first steps from all states.

    Runs from different states meet after a few characters nearly always, so all
    states are followed until they have met and one of them from there.
    """
    steps, n = kinds.shape
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], n, 1)
    first = min(24, steps)
    for t in range(first):
        state = STEP[state * np.uint8(CLASSES) + kinds[t]]
    met = (state == state[0]).all(0)
    one = state[0]
    for t in range(first, steps):
        one = STEP[one * np.uint8(CLASSES) + kinds[t]]
    apart = np.flatnonzero(~met)
    state = np.repeat(one[None], STATES, 0) if first < steps else state
    if len(apart) and first < steps:
        some = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], len(apart), 1)
        for t in range(steps):
            some = STEP[some * np.uint8(CLASSES) + kinds[t, apart]]
        state[:, apart] = some
    return state.T.copy()


def entry_states(maps: np.ndarray) -> np.ndarray:
    """State in which each chunk is entered: prefix scan over compositions of maps, from START."""
    scan = maps.copy()
    d = 1
    while d < len(scan):
        # scan[i] after scan[i - d]: twice the span with each round
        scan[d:] = np.take_along_axis(scan[d:], scan[:-d].astype(np.intp), 1)
        d *= 2
    entry = np.full(len(maps), START, np.uint8)
    entry[1:] = scan[:-1, START]
    return entry


def starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a pre-token begins, for a stream of classes with END after every text."""
    n = len(kinds)
    chunks = -(-n // chunk)
    padded = np.zeros(chunks * chunk, np.uint8)
    padded[:n] = kinds
    by_step = np.ascontiguousarray(padded.reshape(chunks, chunk).T)
    state = entry_states(chunk_maps(by_step))
    marks = np.empty_like(by_step)
    for t in range(chunk):
        at = state * np.uint8(CLASSES) + by_step[t]
        marks[t] = MARK[at]
        state = STEP[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return begins


def streams(texts: list[str], longest: int = STREAM):
    """Consecutive texts in groups of about ``longest`` characters: (first, after last)."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= longest:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Two 64-bit hashes of any span of a stream, from prefix sums of base ** i * mix(character)."""

    def __init__(self):
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def hashes(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        n = len(points)
        if not self.powers or len(self.powers[0][0]) < n:
            room = 1 << (n + 1).bit_length()
            inverse = [pow(int(b), -1, 1 << 64) for b in BASES]
            self.powers = [(_powers(int(b), room), _powers(i, room)) for b, i in zip(BASES, inverse)]
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        length = (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = []
        for forward, back in self.powers:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed * forward[:n], out=sums[1:])
            h = (sums[end] - sums[begin]) * back[begin]
            out.append(h ^ (h >> np.uint64(31)) ^ length)
        return out


class Memo:
    """Values for spans seen before: two sorted levels of hash -> (check, value)."""

    def __init__(self, most: int):
        self.most = most
        self.levels = [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def get(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Value for each key, -1 where unknown."""
        out = np.full(len(key), -1, np.int64)
        for keys, checks, values in self.levels:
            if len(keys):
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = (keys[at] == key) & (checks[at] == check)
                out[hit] = values[at[hit]]
        return out

    def put(self, key: np.ndarray, check: np.ndarray, value: np.ndarray) -> bool:
        """Remember sorted new keys; when full, forget everything first and say so."""
        full = sum(len(level[0]) for level in self.levels) + len(key) > self.most
        if full:
            self.levels = [self._empty(), self._empty()]
        self.levels[1] = self._merged(self.levels[1], (key, check, value))
        if 4 * len(self.levels[1][0]) > len(self.levels[0][0]):
            self.levels = [self._merged(*self.levels), self._empty()]
        return full

    @staticmethod
    def _merged(a, b) -> tuple[np.ndarray, ...]:
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)
