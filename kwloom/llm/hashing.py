"""Words, word hashes and hashes of word runs of Arrow text, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors of the two independent run hashes.
RUNS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mixed(h: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, size: int) -> np.ndarray:
    """base**0 .. base**(size - 1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < size:
        grown = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(grown)
    return have[:size]


@dataclass
class Words:
    """Words of a batch: where they are in ``data``, whose they are, and a hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    per_doc: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Runs of bytes other than ASCII white space; a null text has none."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first = int(offsets[0])
        data = np.frombuffer(data, dtype=np.uint8)[first:int(offsets[-1])] if data else np.zeros(0, dtype=np.uint8)
        offsets = offsets - first
        word = ~_SPACE[data]
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]  # of texts that have bytes
        head[edges] = word[edges]
        tail[edges[1:] - 1] = word[edges[1:] - 1]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * powers(_STEP, len(data)), out=total[1:])
        hashes = total[ends] - total[starts]
        hashes *= powers(_inverse(_STEP), len(data))[starts] if len(starts) else np.uint64(1)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        per_doc = np.bincount(doc, minlength=len(texts))
        return cls(data, starts, ends, doc, mixed(hashes), per_doc)

    def runs(self, size: int, factor: np.uint64 = RUNS[0]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` consecutive words of one text."""
        count = len(self.hashes) - size + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[size - 1:])
        total = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * powers(factor, len(self.hashes)), out=total[1:])
        h = (total[at + size] - total[at]) * powers(_inverse(factor), len(self.hashes))[at]
        return at, mixed(h)
