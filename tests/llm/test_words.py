from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphspark.llm.packing import pack, unpack
from graphspark.llm.words import ALNUM, NOT_SPACE, slices, tokenise

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé中😀 \t\n\r\x0b'-_09", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_tokenise(texts):
    for table, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        for lower in (False, True):
            fold = (lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)) if lower else (lambda t: t)
            words = [re.findall(pattern, fold(t or "")) for t in texts]
            tokens, counts = tokenise(pa.array(texts, pa.string()), table, lower)
            assert counts.tolist() == [len(w) for w in words]
            assert tokens.to_pylist() == [x for w in words for x in w]


@settings(max_examples=50, deadline=None)
@given(texts=TEXTS, most=st.integers(1, 40), rows=st.integers(1, 5))
def test_slices_keep_all_rows(texts, most, rows):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = list(slices(batch, "text", most, rows))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(0 < p.num_rows <= rows for p in parts)


@settings(max_examples=50, deadline=None)
@given(values=st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    a = np.array(values, dtype=np.uint64)
    assert unpack(pack(a), len(a), np.uint64).tolist() == values
    assert unpack(pack(np.sort(a), delta=True), len(a), np.uint64, delta=True).tolist() == sorted(values)
