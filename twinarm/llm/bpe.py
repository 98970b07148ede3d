"""Token ids by the tokenizers library, with a word cache in numpy.

BPE merges never cross the pieces into which a pre-tokenizer cuts a text, so ids are the concatenation of the pieces' ids. For the two
pre-tokenizers below the cuts are found in numpy and each distinct piece is given to the library once. Texts with
characters outside ASCII and Latin-1, where regex engines could differ, and tokenizer files with other pre-tokenizers go to the library whole.
Texts with the string of an added token, which the library takes for that token, go to it whole as well.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .common import resident

#: Characters handled at once; longer texts are cut between two ASCII words, where no piece, normalisation or look-ahead crosses.
CHUNK_CHARS = 1 << 19
#: Distinct pieces kept; at about 50 bytes each, this bounds the cache to 50 MB a worker.
CACHE_WORDS = 1_000_000

_UNSAFE, _L, _N, _O, _S = range(5)
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def _classes() -> np.ndarray:
    kinds = {"L": _L, "N": _N}
    t = np.zeros(256, np.uint8)
    for c in [*range(0x20, 0x7F), *range(0xA1, 0x100)]:
        t[c] = kinds.get(unicodedata.category(chr(c))[0], _O)
    t[[0x09, 0x0A, 0x0D, 0x20]] = _S
    return t


CLASS = _classes()
_FOREIGN = re.compile("[^%s]" % "".join(re.escape(chr(c)) for c in np.flatnonzero(CLASS)))
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(256)], np.uint8)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _starts_spaced(cp: np.ndarray, cls: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Piece starts where a space belongs to the word after it, and white space before that is a piece."""
    space = cls == _S
    prev_space = np.empty_like(space)
    prev_space[0], prev_space[1:] = False, space[:-1]
    prev_blank = np.zeros_like(space)
    prev_blank[1:] = cp[:-1] == 0x20
    changed = np.ones_like(space)
    changed[1:] = cls[1:] != cls[:-1]
    start = first | (~space & changed & ~prev_blank) | (space & ~prev_space)
    ends_run = space & ~last
    ends_run[:-1] &= ~space[1:]
    return start | ends_run


def _starts_bare(cp: np.ndarray, cls: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Piece starts where white space is dropped (here: pieces of their own) and each digit stands alone."""
    start = first | (cls == _N)
    start[1:] |= cls[1:] != cls[:-1]
    return start


def _contractions(start: np.ndarray, cp: np.ndarray, cls: np.ndarray, first: np.ndarray, end_of: np.ndarray, blank_joins: bool) -> None:
    """'s 't 'm 'd 're 've 'll are pieces where an apostrophe begins one. end_of: where each character's text ends."""
    n = len(cp)
    for i in np.flatnonzero(cp == 0x27):
        if not first[i] and (cls[i - 1] == _O or blank_joins and cp[i - 1] == 0x20):
            continue
        stop = end_of[i]
        one = chr(cp[i + 1]) if i + 1 < stop else ""
        two = one + chr(cp[i + 2]) if i + 2 < stop else ""
        k = 1 if one and one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if k:
            start[i + 1 : i + 1 + k] = False
            if i + 1 + k < min(stop, n):
                start[i + 1 + k] = True


class Encoder:
    """encode(texts) gives (ids, counts): all ids, uint32, and how many belong to each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added), re.I) if added else None
        self.rule, self.lower = None, False
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [{}]
        if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.rule = _starts_spaced
        elif parts[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and "Lowercase" in str(spec["normalizer"]):
            self.rule, self.lower = _starts_bare, True
        self._powers(1 << 16)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.slot = np.zeros(0, np.int64)
        self.offset, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _powers(self, n: int) -> None:
        self.power, self.inverse = (np.cumprod(np.full(n, x, np.uint64)) for x in (_MULTIPLIER, _INVERSE))

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.known) and len(self.known) + len(hashes) > CACHE_WORDS:
            raise OverflowError
        encoded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(count.sum()))
        base = len(self.count)
        self.offset = np.concatenate([self.offset, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, flat])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.slot = np.insert(self.slot, at, base + np.arange(len(hashes)))

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("latin-1"), np.uint8)
        n = len(cp)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.lower:
            cp = _LOWER[cp]
        cls = CLASS[cp]
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        full = lens > 0
        first[(ends - lens)[full]] = True
        last[ends[full] - 1] = True
        start = self.rule(cp, cls, first, last)
        if b"'" in joined.encode("latin-1"):
            _contractions(start, cp, cls, first, np.repeat(ends, lens), self.rule is _starts_spaced)
        at = np.flatnonzero(start)
        stop = np.append(at[1:], n)
        if self.rule is _starts_bare:
            word = cls[at] != _S
            at, stop = at[word], stop[word]
        if n > len(self.power):
            self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_MIX[cp] * self.power[:n], out=sums[1:])
        hashes = (sums[stop] - sums[at]) * self.inverse[at] + (stop - at).astype(np.uint64)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, unique)
        new = self.known[np.minimum(pos, len(self.known) - 1)] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            pieces = [joined[a:b] for a, b in zip(at[index[new]].tolist(), stop[index[new]].tolist())]
            try:
                self._learn(unique[new], pieces)
            except OverflowError:
                self._forget()
                pieces = [joined[a:b] for a, b in zip(at[index].tolist(), stop[index].tolist())]
                self._learn(unique, pieces)
            pos = np.searchsorted(self.known, unique)
        slot = self.slot[pos][inverse]
        count = self.count[slot]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.pool[np.repeat(self.offset[slot] - total[:-1], count) + np.arange(total[-1])]
        bounds = np.searchsorted(at, np.concatenate([[0], ends]))
        return ids, np.diff(total[bounds])

    def _chunks(self, texts):
        """Lists of (index of text, segment) of about CHUNK_CHARS."""
        held, size = [], 0
        for k, text in enumerate(texts):
            a = 0
            while True:
                cut = _CUT.search(text, a + CHUNK_CHARS) if len(text) - a > 2 * CHUNK_CHARS else None
                b = cut.start() if cut else len(text)
                held.append((k, text[a:b] if a or cut else text))
                size += b - a
                if size >= CHUNK_CHARS:
                    yield held
                    held, size = [], 0
                a = b
                if not cut:
                    break
        if held:
            yield held

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        for held in self._chunks([t or "" for t in texts]):
            fast = [self.rule is not None and not _FOREIGN.search(s) and not (self.added and self.added.search(s)) for _, s in held]
            ids, n = self._fast([s for (_, s), f in zip(held, fast) if f])
            if all(fast):
                out.append(ids)
                np.add.at(counts, [k for k, _ in held], n)
                continue
            slow = iter(self.library.encode_batch_fast([s for (_, s), f in zip(held, fast) if not f], add_special_tokens=False))
            at, n = 0, iter(n)
            for (k, _), f in zip(held, fast):
                if f:
                    m = int(next(n))
                    out.append(ids[at : at + m])
                    at += m
                else:
                    out.append(np.array(next(slow).ids, np.uint32))
                counts[k] += len(out[-1])
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, until tasks of other kinds need the memory."""
    kept = resident.setdefault("bpe", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
