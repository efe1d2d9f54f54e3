"""Units of texts that are read together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tieline.llm import toxicity


def test_units_of_texts_together_are_those_of_each():
    texts = ["You i d i o t. Fine!", "", " . ", "a b\nc d e f you you", "x " * 70 + "end."]
    both = toxicity.units_of(pa.array(texts))
    for n, at in enumerate(both.places()):
        alone = toxicity.units_of(pa.array([texts[n]]))
        assert [both.words[k] for k in both.at[at]] == [alone.words[k] for k in alone.at]
        starts = both.sentence_start[both.text_start[n] : both.text_start[n + 1] + 1] - at.start
        assert np.array_equal(starts, alone.sentence_start)


def test_parts_of_batches_hold_every_text():
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(range(n))}) for n in (0, 3, 7)]
    parts = list(toxicity._parts(iter(batches), 3))
    assert [p.num_rows for p in parts] == [3, 3, 3, 1]
    assert [v for p in parts for v in p.column("k").to_pylist()] == [0, 1, 2, *range(7)]
