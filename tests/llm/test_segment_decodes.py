"""Which paths stand for their text, byte by byte."""

import os

import numpy as np
import pytest

from candela.llm import segment

pytestmark = pytest.mark.skipif(not os.path.exists(segment.MODEL), reason="no piece file")


def test_decodes_tells_wrong_bytes_and_wrong_sizes():
    pieces = segment.Pieces.load()
    texts = [b"ab", b"", b"ab", b"abc", b"b"]
    byte = pieces.byte_ids
    paths = [[*byte[list(b" ab")]], [], [*byte[list(b" ax")]], [*byte[list(b" ab")]], [*byte[list(b" b")]]]
    ids, sizes = np.array(sum(paths, []), np.int64), np.array([len(p) for p in paths])
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = segment._decodes(pieces, ids, sizes, np.frombuffer(b"".join(texts), np.uint8), offsets, np.arange(5))
    assert got.tolist() == [True, True, False, False, True]
