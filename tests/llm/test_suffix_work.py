"""What the passes of the suffix order bring together and sort."""

import numpy as np
import pyarrow as pa

from candela.llm import suffix

LENGTH = 50


def _told(strings: list[bytes], ids: list[int]) -> pa.RecordBatch:
    row = {"bucket": 0, "chunk": 7, "size": bytes(map(len, strings)), "body": suffix._pack(b"".join(strings)), "least": suffix._pack(np.array(ids, np.int64).tobytes())}
    return pa.RecordBatch.from_pylist([row])


def test_only_runs_of_windows_that_recur_are_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    text = [rng.integers(97, 123, 76).astype(np.uint8).tobytes() for _ in range(6)]
    gram = text[0][26:50]
    # four pieces with a gram in common and nothing more; two that have 55 bytes in common, six windows
    strings = [*[t[:26] + gram + t[50:] for t in text[:4]], text[4], text[5][:21] + text[4][21:]]
    seen = []

    class Seen(suffix.Collection):
        def __init__(self, data, begin, end, folder):
            seen.append((end - begin).tolist())
            super().__init__(data, begin, end, folder)

    monkeypatch.setattr(suffix, "Collection", Seen)
    out = list(suffix._sort(LENGTH)(iter([_told(strings, [9, 8, 7, 6, 5, 4])])))[0].to_pylist()[0]
    assert seen == [[55, 55]]
    runs, ids = np.frombuffer(suffix._unpack(out["runs"]), np.int32), np.frombuffer(suffix._unpack(out["ids"]), np.int64)
    assert np.repeat(ids, runs).tolist() == sum(([i] * 27 for i in (9, 8, 7, 6)), []) + [5] * 21 + [4] * 6 + [4] * 27


def test_recurring_windows_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        length = int(rng.integers(1, 6))
        windows = rng.integers(1, 9, int(rng.integers(1, 7)))
        size = windows + length - 1
        begin = np.cumsum(size) - size
        body = rng.integers(0, 3, int(size.sum())).astype(np.uint8)
        whole = [body[b + i: b + i + length].tobytes() for b, n in zip(begin, windows) for i in range(n)]
        wanted = {(p, i) for k, (p, i) in enumerate((p, i) for p, n in enumerate(windows) for i in range(n)) if whole.count(whole[k]) > 1}
        piece, first, n = suffix.recurring(body, begin, windows, length)
        got = [(p, f + i) for p, f, m in zip(piece.tolist(), first.tolist(), n.tolist()) for i in range(m)]
        assert len(got) == len(set(got)) and set(got) == wanted
        assert all((p, f + m) not in wanted and (p, f - 1) not in wanted for p, f, m in zip(piece.tolist(), first.tolist(), n.tolist()))


def test_pieces_of_periodic_rows_keep_to_their_span():
    data = np.frombuffer(b"a" * 200 + b"b" * 49 + b"ab" * 60, np.uint8)
    start, windows, _, row = suffix.pieces(data, np.array([0, 200, 200, 249, 369]), LENGTH, 24)
    assert windows.max() == 27 and np.bincount(row, windows, 4).tolist() == [151, 0, 0, 71]
    assert all(z <= (200, 200, 249, 369)[r] for z, r in zip((start + windows + LENGTH - 1).tolist(), row.tolist()))
