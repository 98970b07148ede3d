"""Word shingle sets as 64-bit hashes, in numpy.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A set has the distinct shingles of five words; a text of fewer words has its whole
sequence as one; a text without words has the empty set.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at once; longer texts are cut at white space.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers[0]):
        size = 1 << n.bit_length()
        for k, x in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.full(size, x, np.uint64))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string, and where they start."""
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_MIX[b] * up[: len(b)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)), start


def _chunks(texts: list[str]):
    """(bytes, first text, ends of texts in the bytes, whether the last goes on): consecutive texts, or a part of a long one."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass").lower()
        while len(raw) > 2 * CHUNK:
            cut = min((p for p in (raw.find(c, CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0), default=-1)
            if cut < 0:
                break
            if held:
                yield held, first
                held, size = [], 0
            yield [raw[:cut]], k
            first, raw = k, raw[cut:]
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield held, first
            held, size, first = [], 0, k + 1
    if held:
        yield held, first


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The words of each text, hashed."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for held, first in _chunks(texts):
        ends = np.cumsum([len(r) + 1 for r in held])
        hashes, start = _hash_words(b"\n".join(held))
        for k, part in enumerate(np.split(hashes, np.searchsorted(start, ends[:-1]))):
            out[first + k].append(part)
    return [np.concatenate(p) if len(p) != 1 else p[0] for p in (p or [np.zeros(0, np.uint64)] for p in out)]


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    found = []
    for w in word_hashes([t or "" for t in texts]):
        k = min(len(w), WORDS)
        if not k:
            found.append(w)
            continue
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(_STEP) + w[i : len(w) - k + 1 + i]
        found.append(np.unique(mix(h)))
    return found
