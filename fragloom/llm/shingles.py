r"""Word and shingle hashes of whole texts, vectorised over Arrow batches.

Words are runs of [^\x20\x09-\x0D] with A-Z in lower case. A word's hash is a polynomial in random 64-bit values of its
bytes, taken from prefix sums of a buffer of many documents at once, then mixed; a shingle's hash is a polynomial of its
words' hashes, mixed. Buffers hold SEGMENT bytes, longer only for a single longer word, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
SIZE = 5

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 4 * SEGMENT:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_VALUE[raw] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U)), starts


def documents_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes, words before each document and after the last) of runs of documents in order."""
    first, parts, held = 0, [], 0

    def flush():
        buffer = b" ".join(parts)
        hashes, starts = word_hashes(np.frombuffer(buffer, np.uint8))
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
        return hashes, np.searchsorted(starts, offsets)

    for i, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if parts and held + len(raw) > SEGMENT:
            yield first, *flush()
            first, parts, held = i, [], 0
        if len(raw) > SEGMENT:
            found, at = [], 0
            view = np.frombuffer(raw, np.uint8)
            while at < len(view):
                end = min(at + SEGMENT, len(view))
                while end < len(view) and not _SPACE[view[end]]:
                    gap = np.flatnonzero(_SPACE[view[end : end + SEGMENT]])
                    end = end + int(gap[0]) if len(gap) else min(end + SEGMENT, len(view))
                found.append(word_hashes(view[at:end])[0])
                at = end
            hashes = np.concatenate(found)
            yield i, hashes, np.array([0, len(hashes)])
            first = i + 1
            continue
        parts.append(raw)
        held += len(raw) + 1
    if parts:
        yield first, *flush()


def _fold(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * _STEP + words[k : k + n]
    return mix(out + _U(size))


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, sorted distinct shingle hashes of a run of documents, offsets of the documents in them).

    A document of fewer words has the whole sequence as its one shingle; one without words has none."""
    with np.errstate(over="ignore"):
        for first, words, bounds in documents_words(texts):
            windows = _fold(words, size) if len(words) >= size else words[:0]
            sets = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a >= size:
                    s = np.sort(windows[a : b - size + 1])
                    sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
                else:
                    sets.append(_fold(words[a:b], b - a) if b > a else words[:0])
            yield first, np.concatenate(sets), np.cumsum([0, *map(len, sets)])
