"""Words that come again in a partition have their lattice built once more at most, and paths are the same with it."""

import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from candela.llm import segment

pytestmark = pytest.mark.skipif(not os.path.exists(segment.MODEL), reason="no piece file")


def _rows(pieces, texts, room, monkeypatch):
    monkeypatch.setattr(segment, "SLICE", 1)  # a text is a slice
    monkeypatch.setattr(segment, "ROOM", room, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["key", "_seed", "text"])
    return [r for b in segment._segmenter(SimpleNamespace(value=pieces), 3, 17, True)(iter([batch])) for r in b.to_pylist()]


def test_words_that_came_before_are_not_built_again(monkeypatch):
    pieces, built = segment.Pieces.load(), []
    lattice = segment._words_lattice

    def counted(pieces, text, start, length):
        built.append(int(length.sum()))
        return lattice(pieces, text, start, length)

    monkeypatch.setattr(segment, "_words_lattice", counted)
    texts = ["unbelievable straightforwardness encountered elsewhere", "elsewhere encountered Unbelievable straightforwardness", "straightforwardness unbelievable encountered elsewhere", "encountered 這個 straightforwardness \U0001f600elsewhere"]
    rows, whole = _rows(pieces, texts, 700_000, monkeypatch), sum(len(t.encode()) + 1 for t in texts)
    assert sum(built) < whole * 0.7
    assert rows == _rows(pieces, texts, 0, monkeypatch) and all(r["decoded"] for r in rows) and len(rows) == 12


def test_decodes_tells_wrong_bytes_late_in_a_long_piece():
    pieces = segment.Pieces.load()
    piece = int(np.flatnonzero((pieces.size >= 12) & [r.startswith(b" ") for r in pieces.raw])[0])
    text = pieces.raw[piece][1:]
    for at in range(len(text)):
        other = text[:at] + bytes([text[at] ^ 1]) + text[at + 1:]
        data = np.frombuffer(text + other, np.uint8)
        got = segment._decodes(pieces, np.array([piece, piece]), np.array([1, 1]), data, np.array([0, len(text), 2 * len(text)]), np.arange(2))
        assert got.tolist() == [True, False]
