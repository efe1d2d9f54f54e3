"""Token ids of whole texts from the tokenizers library, each distinct pre-token encoded once.

Pre-tokens are encoded independently of each other, so a worker asks the library
for pre-tokens it has not met and puts texts together from remembered ids.  The
cuts between pre-tokens are found here for characters below U+0180, where the
two split patterns are simple; a text with any other character, or with what
might be a special string, goes to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tieline.llm import pretokens as pt
from tieline.llm.token_counts import parts_of

SIMPLE = 0x180
WORDS, BYTES = "words", "bytes"


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where spans begin for the pattern that drops white space and takes digits one by one."""
    group = np.array([0, 1, 1, 1, 1, 1, 2, 3, 3, 0, 0], np.uint8)[kinds]
    begins = np.ones(len(group), bool)
    begins[1:] = (group[1:] != group[:-1]) | (group[1:] == 2)
    quote = np.flatnonzero((kinds == pt.APOSTROPHE) & begins)
    quote = quote[quote + 3 < len(kinds)] if len(quote) else quote  # streams end with padding
    if len(quote):
        a, b = points[quote + 1], points[quote + 2]
        one = (kinds[quote + 1] == pt.ONE)
        two = ((kinds[quote + 1] == pt.RV) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        begins[quote[one | two] + 1] = False
        begins[quote[two] + 2] = False
        begins[quote[one] + 2] = True
        begins[quote[two] + 3] = True
    return begins


class Encoder:
    """Ids as the library gives them without added special tokens; keeps what it has seen."""

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = self._kind(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.kinds = pt.character_classes(SIMPLE)
        self.spans, self.memo = pt.Spans(), pt.Memo(most)
        self._forget()

    @staticmethod
    def _kind(spec: dict) -> str | None:
        """Which of the two split patterns the file has; None: every text goes to the library."""
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        if norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return BYTES
        steps = [n["type"] for n in norm.get("normalizers", [])] if norm else []
        splits = pre.get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex")
        if steps == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return WORDS
        return None

    def _forget(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        owner, parts = [], []
        for k, text in enumerate(texts):
            simple = self.kind and (text.isascii() or max(text) < chr(SIMPLE)) and not any(s in text for s in self.special)
            if self.kind == WORDS and simple and "İ" in text:
                simple = False
            if not simple:
                out[k].append(self._library(text))
                continue
            for part in parts_of(text):
                owner.append(k)
                parts.append(part)
        for a, b in pt.streams(parts):
            for k, ids in zip(owner[a:b], self._stream(parts[a:b])):
                out[k].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]

    def _stream(self, parts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(parts) + "\0\0\0\0"
        if self.kind == WORDS:
            joined = joined.lower()
        points = pt.code_points(joined)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds = self.kinds[points]
        kinds[ends] = kinds[-3:] = pt.END
        begin = np.flatnonzero(pt.starts(kinds) if self.kind == BYTES else word_starts(points, kinds))
        end = np.append(begin[1:], len(points))
        dropped = (pt.END,) if self.kind == BYTES else (pt.END, pt.BLANK, pt.SPACE)
        real = ~np.isin(kinds[begin], dropped)
        begin, end = begin[real], end[real]
        key, check = self.spans.hashes(points, begin, end)
        known, first, at = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check[first][at], check):
            return [self._library(p) for p in parts]
        value = self.memo.get(known, check[first])
        new = np.flatnonzero(value < 0)
        if len(new) and self._learn(known, check[first], value, new, joined, begin[first], end[first]):
            return self._stream(parts)  # the memory was cleared to make room
        sizes = self.count[value][at]
        shift = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.begin[value][at] - shift, sizes) + np.arange(int(sizes.sum()))]
        per = np.bincount(np.searchsorted(ends, begin), sizes, len(parts)).astype(np.int64)
        return np.split(ids, np.cumsum(per)[:-1])

    def _learn(self, known, check, value, new, joined, begin, end) -> bool:
        words = [joined[b:e] for b, e in zip(begin[new].tolist(), end[new].tolist())]
        ids = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        if len(self.count) and len(self.count) + len(new) > self.memo.most:
            self.memo = pt.Memo(self.memo.most)
            self._forget()
            return True
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        value[new] = len(self.count) + np.arange(len(new))
        self.begin = np.append(self.begin, self.used + np.cumsum(sizes) - sizes)
        self.count = np.append(self.count, sizes)
        self.used += total
        self.memo.most = max(self.memo.most, len(self.count))
        self.memo.put(known[new], check[new], value[new])
        return False


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
