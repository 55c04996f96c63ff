"""Token n-grams of Arrow text as 64-bit hashes, and a filter of the hashes that matter.

Most n-grams of a corpus occur once, and no result names them. So n-grams are hashed in array
arithmetic, counted by hash, and only those whose hash passes become strings, are counted again
by string, and cross a shuffle as such. A hash may let a string too many through, never too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that become arrays at a time.
CHUNK = 1 << 20
#: Bits of a filter: sixteen for each hash, within these bounds (64 MB). A fuller one passes more rows.
BITS = (1 << 12, 1 << 29)
#: Hashes that a task holds before it passes them on, and the slices by which they are counted.
HELD, SLICES = 1 << 21, 1 << 9

_ODD = np.random.default_rng(11).integers(0, 2**63, 260, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _PLACE, _STEP = _ODD[:256], _ODD[256:259], _ODD[259]
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _spun(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[7]
    h ^= h >> np.uint64(29)
    h *= _ODD[70]
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Tokens:
    """The tokens of a chunk, one space apart in ``data``: where, of which row, and a hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, least: int = 2) -> Tokens:
        """Runs of bytes other than the space, of ``least`` characters or more; none of a null."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        solid = data != 32
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]  # where one text follows another
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        kept = letters[end] - letters[start] >= least
        start, end = start[kept], end[kept]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=total[1:])
        hashes = _spun((total[end] - total[start]) * _powers(_UNSTEP, len(data) + 1)[start])
        row = np.searchsorted(offsets, start, side="right") - 1
        size = end - start
        begin = np.cumsum(size + 1) - (size + 1)
        packed = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
        packed[ranges(begin, size)] = data[ranges(start, size)]
        return cls(packed, begin, begin + size, row, hashes)

    def grams(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, tokens, hash) of every n-gram inside a row, shorter ones first."""
        firsts, sizes, hashes = [], [], []
        for n in range(lo, hi + 1):
            count = max(len(self.hashes) - n + 1, 0)
            at = np.flatnonzero(self.row[:count] == self.row[n - 1:n - 1 + count])
            mixed = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                mixed = _spun(mixed + self.hashes[at + k] * _PLACE[k % 3])
            firsts.append(at)
            sizes.append(np.full(len(at), n))
            hashes.append(mixed)
        return np.concatenate(firsts), np.concatenate(sizes), np.concatenate(hashes)

    def text(self, first: np.ndarray, size: np.ndarray) -> pa.Array:
        """The n-grams as strings, tokens one space apart."""
        begin, length = self.start[first], self.end[first + size - 1] - self.start[first]
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        data = self.data[ranges(begin, length)]
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))

    def edges_in(self, first: np.ndarray, size: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """Whether the first or the last token of each n-gram is among the sorted hashes ``listed``."""
        stop = np.isin(self.hashes, listed)
        return stop[first] | stop[first + size - 1]


def token_hashes(tokens: Iterable[str]) -> np.ndarray:
    """Hashes of single tokens."""
    return Tokens.of(pa.array(list(tokens), pa.string()), 1).hashes


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of one occurrence, occurrences, rows) of each distinct hash; ``rows`` rise for equal hashes."""
    order = np.argsort(hashes, kind="stable")
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    other = new.copy()
    other[1:] |= r[1:] != r[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(h)))
    return order[start], count, np.add.reduceat(other.astype(np.int64), start) if len(start) else count


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of a text column, a row at least."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        of = (np.cumsum(size.astype(np.int64)) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield batch.slice(begin, end - begin)


@dataclass
class HashFilter:
    """A Bloom filter of 64-bit hashes with two places each."""

    words: np.ndarray
    bits: int

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def hash_filter(hashes: DataFrame, column: str = "h") -> HashFilter:
    """A filter that every hash of a table passes; built by Spark, of bounded size on the driver."""
    n = hashes.count()
    bits = int(min(max(1 << (16 * max(n, 1) - 1).bit_length(), BITS[0]), BITS[1]))
    place = F.explode(F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in (0, 32))))
    word = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("mask")
    )
    words = np.zeros(bits >> 6, dtype=np.uint64)
    for found in word.toArrow().to_batches():
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return HashFilter(words, bits)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in rising order and the sum of the counts of each."""
    order = np.argsort(hashes)
    h = hashes[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), dtype=bool), h[1:] != h[:-1]]))
    return h[start], np.add.reduceat(counts[order], start) if len(start) else counts


def hash_counts(
    texts: DataFrame, text_col: str, rows: Callable[[Tokens], tuple[np.ndarray, np.ndarray]], least: int = 1
) -> DataFrame:
    """(h, df): the sum of the counts that ``rows`` gives each hash, where it is ``least`` or more.

    Hashes cross the shuffle as bytes, by slices of their range; a task counts one slice at a time.
    """
    kinds = (pa.int32(), pa.binary(), pa.binary())

    def passed_on(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        of = (h >> np.uint64(64 - (SLICES - 1).bit_length())).astype(np.int32)
        cuts = np.searchsorted(of, np.arange(SLICES + 1))
        full = np.flatnonzero(np.diff(cuts))
        made = full.tolist(), [h[cuts[s]:cuts[s + 1]].tobytes() for s in full], [n[cuts[s]:cuts[s + 1]].astype(np.int64).tobytes() for s in full]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["slice", "h", "df"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, text_col):
            held.append(rows(Tokens.of(batch.column(text_col))))
            size += len(held[-1][0])
            if size >= HELD:
                yield passed_on(held)
                held, size = [], 0
        if size:
            yield passed_on(held)

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["h", "df"])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for number, h, n in zip(*batch.columns, strict=True):
                if held and number != at:
                    yield told(held)
                    held = []
                at = number
                held.append((np.frombuffer(h.as_py(), dtype=np.uint64), np.frombuffer(n.as_py(), dtype=np.int64)))
        if held:
            yield told(held)

    sliced = texts.mapInArrow(run, "slice int, h binary, df binary").repartition("slice").sortWithinPartitions("slice")
    return sliced.mapInArrow(merged, "h long, df long")


def gram_rows(
    texts: DataFrame, text_col: str, rows: Callable[[Tokens, pa.RecordBatch], dict[str, pa.Array | np.ndarray]], schema: str, least: int = 2
) -> DataFrame:
    """What ``rows`` makes of each chunk's tokens, as a table of ``schema``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            made = rows(Tokens.of(batch.column(text_col), least), batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in made.values()], names=list(made))

    return texts.mapInArrow(run, schema)
