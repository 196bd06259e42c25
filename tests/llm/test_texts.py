"""Words, lines and shingles of Arrow columns against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from bandwright.llm import texts as T

TEXT = st.one_of(st.none(), st.text(alphabet="ab é日\t\n\x0b\r\x1c.A", max_size=40))


def spans(texts, found):
    raw = texts.data.tobytes()
    cut = [raw[a:b].decode() for a, b in zip(found.starts, found.ends)]
    return [cut[a:b] for a, b in zip(found.offsets[:-1], found.offsets[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_and_lines(column):
    texts = T.column_bytes(pa.array(column, pa.string()))
    plain = [x or "" for x in column]
    assert spans(texts, T.words(texts)) == [re.findall(r"[^\x20\x09-\x0D]+", x) for x in plain]
    assert spans(texts, T.lines(texts)) == [x.split("\n") for x in plain]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 4))
def test_shingles_are_equal_where_words_are(column, size):
    texts = T.column_bytes(pa.array(column, pa.string()))
    words = T.words(texts)
    hashes, starts = T.shingles(T.run_hashes(texts.data, words), words.offsets, size)
    listed = spans(texts, words)
    flat = [w for text in listed for w in text]
    expected = [tuple(t[i : i + size]) for t in listed for i in range(len(t) - size + 1)]
    assert [tuple(flat[i : i + size]) for i in starts] == expected
    assert len(set(hashes.tolist())) == len(set(expected))


def test_slices_keep_every_row_and_bound_their_text(monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 100)
    column = ["x" * n for n in (0, 10, 95, 300, 5, 40, 60, 0)] + [None]
    batch = pa.record_batch({"text": pa.array(column), "n": pa.array(range(9))})
    cut = list(T.slices(iter([batch, batch.slice(0, 0)]), "text"))
    assert [x for part in cut for x in part.column("text").to_pylist()] == column
    assert all(
        part.num_rows == 1 or sum(len(x or "") for x in part.column("text").to_pylist()) <= 400
        for part in cut
    )


def test_hash_of_a_range_depends_on_its_bytes_only():
    data = np.frombuffer(b"abcabcab", np.uint8)
    hashed = T.Prefixes(data).hash(np.array([0, 3, 0, 2]), np.array([3, 6, 2, 5]))
    assert hashed[0] == hashed[1] and len(set(hashed.tolist())) == 3
