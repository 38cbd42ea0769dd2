"""Sets of hashed word shingles of many texts at once, with numpy.

Words are runs without white space, A-Z in lower case. A word's hash is a polynomial of its
bytes, read off a running sum over the whole batch; a shingle's hash joins those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_TURN = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_PIECE = 400_000  # bytes of text worked on at a time
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, _PIECE)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            t = np.full(n, b, dtype=np.uint64)
            t[0] = 1
            _powers[i] = np.cumprod(t)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _piece(raws: list[bytes], width: int) -> list[np.ndarray]:
    data = b"\n".join(raws)
    a = np.frombuffer(data, dtype=np.uint8)
    n_docs = len(raws)
    if not len(a):
        return [np.zeros(0, dtype=np.uint64)] * n_docs
    visible = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(np.concatenate([[False], visible, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _tables(len(a) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)])])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _TURN[5])
    doc_end = np.cumsum([len(r) + 1 for r in raws])
    doc = np.searchsorted(doc_end, start, side="right")
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n_words) - n_words
    if len(word) >= width:
        m = len(word) - width + 1
        joined = word[:m] * _TURN[0]
        for k in range(1, width):
            joined = joined + mix(word[k : k + m] + np.uint64(int(_TURN[k % 7]) * k & 0xFFFFFFFFFFFFFFFF))  # each place counts in its own way
        joined = mix(joined)
    out = []
    for i in range(n_docs):
        n, at = int(n_words[i]), int(first[i])
        if n >= width:
            out.append(np.unique(joined[at : at + n - width + 1]))
        elif n:
            own = word[at : at + n]
            out.append(mix(np.array([int((own * _TURN[:n] if n <= 7 else mix(own + np.arange(n, dtype=np.uint64))).sum(dtype=np.uint64)) + n & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) ^ _TURN[6]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted set of shingle hashes: all runs of ``width`` words; with fewer words the
    whole sequence as one; without words none."""
    piece: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode().lower()
        if piece and size + len(raw) > _PIECE:
            yield from _piece(piece, width)
            piece, size = [], 0
        piece.append(raw)
        size += len(raw) + 1
    if piece:
        yield from _piece(piece, width)
