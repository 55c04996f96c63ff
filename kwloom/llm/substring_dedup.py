"""Removal of word passages that an earlier document has: a count-min prefilter, then exact groups.

The first pass counts hashes of all windows in a count-min sketch: every task sketches its rows,
the sketches are merged slice by slice. The sketch can only overestimate, so a window it counts
once is unique. The second pass groups the windows counted twice or more by an 87-bit key, exactly;
a task settles by itself what its own rows show, so a window of any frequency sends few rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kwloom.llm.base import Carried, sliced, spread, stored
from kwloom.llm.hashing import RUNS, Words, mixed

WINDOW = 13
#: Rows of the sketch, and cells of one slice of a row.
DEPTH, SLICE_BITS = 2, 22
#: Cells of a row: a power of two, about four times the windows, and within these bounds (two bits
#: a cell in a task's memory at most). Past the upper bound more windows reach the second pass;
#: the result stays the same.
CELL_BITS = (22, 30)
#: Windows a task sketches at a time, and repeated windows it compares at a time.
FLUSH, COMPARED = 3_000_000, 400_000
#: Bytes of text hashed at a time.
PIECE = 1 << 19


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch: other bits of the hash for each row."""
    spun = hashes if row == 0 else (hashes << np.uint64(32)) | (hashes >> np.uint64(32))
    return (spun >> np.uint64(64 - bits)).astype(np.uint32)


def _packed(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers as gaps, one byte each; 255 adds to the next gap."""
    gaps = np.diff(cells.astype(np.int64), prepend=np.int64(-1)) - 1
    more = gaps // 255
    out = np.full(int(more.sum()) + len(gaps), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    ends = steps < 255
    return np.cumsum(steps, dtype=np.int64)[ends] + np.arange(int(ends.sum()))


def _sketches(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """(part, once, more): cells met, and cells met twice or more, of each slice in each task."""

    def flushed(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = min(SLICE_BITS, bits)
        for row in range(DEPTH):
            cells = np.empty(len(hashes), dtype=np.uint32)
            for b in range(0, len(hashes), COMPARED):  # small copies only
                cells[b:b + COMPARED] = _cells(hashes[b:b + COMPARED], row, bits)
            cells.sort()
            first = np.ones(len(cells), dtype=bool)
            np.not_equal(cells[1:], cells[:-1], out=first[1:])
            again = np.unique(cells[~first])
            cells = cells[first]
            mask = np.uint32((1 << low) - 1)
            parts = cells >> np.uint32(low)
            for part in parts[np.flatnonzero(np.diff(parts, prepend=parts[:1] + np.uint32(1)))].tolist():
                ends = [part << low, (part + 1) << low]
                one, two = (x[slice(*np.searchsorted(x, ends))] & mask for x in (cells, again))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row << 16 | part], pa.int32()),
                    "once": pa.array([_packed(one)], pa.binary()),
                    "more": pa.array([_packed(two)], pa.binary()),
                })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(0, dtype=np.uint64), 0
        for batch in sliced(batches, "text", PIECE):
            new = Words.of(batch.column("text")).runs(window)[1]
            if size + len(new) > len(held):
                if size:
                    yield from flushed(held[:size])
                size, held = 0, held if len(held) >= max(FLUSH, len(new)) else np.empty(max(FLUSH, len(new)), dtype=np.uint64)
            held[size:size + len(new)] = new
            size += len(new)
        if size:
            yield from flushed(held[:size])

    return docs.select("text").mapInArrow(run, "part int, once binary, more binary")


def _merged(sketches: DataFrame, bits: int) -> DataFrame:
    """(part, twice): one deflated bitmap of the cells met twice or more, for each slice with any.

    A task streams over the sketches of its slices and holds two bitmaps of one slice.
    """
    cells = 1 << min(SLICE_BITS, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if part is not None and twice.any():
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()),
                    "twice": pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary()),
                })

        for batch in batches:
            for now, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != part:
                    yield from done()
                    part, once, twice = now, np.zeros(cells, dtype=bool), np.zeros(cells, dtype=bool)
                met = _unpacked(one)
                twice[met[once[met]]] = True
                once[met] = True
                twice[_unpacked(two)] = True
        yield from done()

    slices = DEPTH << max(0, bits - SLICE_BITS)
    return (
        sketches.repartition(min(slices, 4096), "part").sortWithinPartitions("part")
        .mapInArrow(run, "part int, twice binary")
    )


def _bitmaps(merged: DataFrame, bits: int) -> list[np.ndarray]:
    """A bitmap for each row of the sketch; of bounded size, DEPTH bits for at most 2**30 cells."""
    low = min(SLICE_BITS, bits)
    rows = [np.zeros(1 << bits >> 3, dtype=np.uint8) for _ in range(DEPTH)]
    for r in merged.toLocalIterator():
        begin = (r.part & 0xFFFF) << low >> 3
        rows[r.part >> 16][begin:begin + (1 << low >> 3)] = np.frombuffer(zlib.decompress(r.twice), dtype=np.uint8)
    return rows


def _repeated(docs: DataFrame, window: int, bits: int, twice: list[np.ndarray]) -> DataFrame:
    """(k1, k2, doc_id, place): the windows that the sketch counts twice or more.

    The last bit of ``k2`` marks windows that a smaller id of the same task also has; their key
    is that of the document. ``place`` is 32 bits of the text's hash and the window's first word.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(twice)

    def settled(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        k1, k2, doc, place = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((doc, k2, k1))
        ranked1, ranked2, ranked = k1[order], k2[order], doc[order]
        head = np.ones(len(k1), dtype=bool)
        head[1:] = (ranked1[1:] != ranked1[:-1]) | (ranked2[1:] != ranked2[:-1])
        sure = np.empty(len(k1), dtype=bool)
        sure[order] = ranked > ranked[np.flatnonzero(head)][np.cumsum(head) - 1]
        k1 = np.where(sure, mixed(doc.view(np.uint64)), k1)
        k2 = (k2.astype(np.int64) << 1) | sure  # rows stay in text order, which shuffles in less space
        return pa.RecordBatch.from_arrays(
            [pa.array(k1.view(np.int64)), pa.array(k2), pa.array(doc), pa.array(place)],
            names=["k1", "k2", "doc_id", "place"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, "text", PIECE):
            words = Words.of(batch.column("text"))
            at, hashes = words.runs(window)
            for row, bitmap in enumerate(sketch.value):
                cells = _cells(hashes, row, bits)
                hit = (bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 > 0
                at, hashes = at[hit], hashes[hit]
            of = words.doc[at]
            first = np.cumsum(words.per_doc) - words.per_doc
            texts = batch.column("row").to_numpy()[of] << 32
            held.append([hashes, _second(words, at, window), batch.column("doc_id").to_numpy()[of], texts | (at - first[of])])
            size += len(at)
            if size >= COMPARED:
                yield settled(held)
                held, size = [], 0
        if size:
            yield settled(held)

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "k1 long, k2 long, doc_id long, place long")


def _second(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """23 more bits for the windows at ``at``, from an independent run hash."""
    first, hashes = words.runs(window, RUNS[1])
    return (hashes[np.searchsorted(first, at)] >> np.uint64(41)).astype(np.int32)


def _texts(df: DataFrame, text_col: str, id_col: str, carried: Carried | None = None) -> DataFrame:
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *(carried.columns if carried else ()),
    )
    return docs.withColumn("row", F.shiftright(F.xxhash64("text"), 32))


def repeated_windows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, place): starts of windows whose words also start in a document with a smaller id.

    ``place`` holds the first word's position in its low 32 bits and 32 bits of the text's hash
    above: rows that share an id keep their own positions.
    """
    docs = _texts(df, text_col, id_col)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # prose has about six characters a word: a power of two of three to six times the windows
    bits = min(max(int(max(size, 1) // 2).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    merged = stored(_merged(_sketches(docs, window, bits), bits))
    key = Window.partitionBy("k1", "k2")
    return (
        _repeated(docs, window, bits, _bitmaps(merged, bits)).withColumn("first", F.min("doc_id").over(key))
        .where((F.col("first") < F.col("doc_id")) | (F.col("k2") % 2 == 1)).select("doc_id", "place")
    )


def _deflated(docs: DataFrame, carried: Carried) -> DataFrame:
    """(doc_id, row, packed) and what is carried: texts deflated, so that they shuffle in less space."""
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, row long, packed binary"), *carried.fields])
    passed, names = carried.inside, schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", PIECE):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            packed = pa.array([None if t is None else zlib.compress(t, 1) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), packed, *(batch.column(n) for n in passed)], names=names
            )

    return docs.mapInArrow(run, schema)


def dedup(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, carry: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without the repeated passages.

    The columns named by ``carry`` follow.

    Words are runs of characters other than ASCII white space. A word goes if a window of
    ``window`` words covers it whose words also start in a document with a smaller id; windows
    are judged on the input. ``kept`` joins the other words by one space. Null and empty texts,
    and texts shorter than a window, keep all they have. Repeated rows of one id count as one
    document and never remove each other; a null id is neither earlier nor later than any.
    The smallest id that has a passage keeps it. Ids are whole numbers. Other columns are not read.
    """
    carried = Carried(df, [c for c in carry if c != text_col])
    docs = _texts(df, text_col, id_col, carried)
    place = F.col("place")
    marks = (
        repeated_windows(df, text_col, id_col, window)
        .groupBy("doc_id", F.shiftright(place, 32).alias("row"))
        .agg(F.collect_list(place.bitwiseAND(F.lit(2**32 - 1)).cast("int")).alias("starts"))  # of one document
    )
    marked = _deflated(docs, carried).join(marks, ["doc_id", "row"], "left")
    marked = marked.select("doc_id", "packed", "starts", *carried.inside)
    whole = [T.StructField("_text", T.StringType())] if text_col in carry else []
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
    schema = T.StructType([*schema, *whole, *carried.fields])
    passed, names = carried.inside, schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "packed", PIECE // 3):
            whole_texts = [None if t is None else zlib.decompress(t) for t in batch.column("packed").to_pylist()]
            whole_texts = pa.array(whole_texts, pa.large_binary())
            words = Words.of(whole_texts)
            first = np.cumsum(words.per_doc) - words.per_doc
            starts = batch.column("starts")
            counts = pa.compute.list_value_length(starts).fill_null(0).to_numpy(zero_copy_only=False)
            at = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at += np.repeat(first, counts)
            cover = np.zeros(len(words.doc) + 1, dtype=np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, np.minimum(at + window, len(words.doc)), -1)
            keep = np.cumsum(cover[:-1]) == 0
            removed = np.bincount(words.doc[~keep], minlength=batch.num_rows)
            data, begins = words.data, words.starts[keep]
            sizes = words.ends[keep] - begins + 1  # with a space after each
            padded = np.append(data, np.uint8(32))
            kept = padded[spread(begins, sizes)]
            total = np.cumsum(sizes)
            kept[total - 1] = 32
            of = words.doc[keep]
            ends = np.searchsorted(of, np.arange(batch.num_rows), side="right")
            ends = np.concatenate([[0], total])[ends]
            begin = np.concatenate([[0], ends[:-1]])
            view = kept.tobytes()
            texts = [view[b:max(b, e - 1)].decode() for b, e in zip(begin.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.per_doc, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(texts, pa.string()),
                    *([whole_texts.cast(pa.large_string()).cast(pa.string())] if whole else []), *(batch.column(n) for n in passed),
                ],
                names=names,
            )

    text = [F.col("_text").alias(text_col)] if whole else []
    return marked.mapInArrow(run, schema).select(
        F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept", *text, *carried.restored()
    )


def duckdb_sql(window: int = WINDOW) -> str:
    """The digests of ``dedup`` over ``documents`` in DuckDB SQL, without a prefilter."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS a FROM w WHERE len(ws) >= {window}),
k AS (SELECT doc_id, a, md5(array_to_string(ws[a:a + {window - 1}], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
m AS (SELECT DISTINCT doc_id, unnest(range(a, a + {window})) AS p FROM k JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM m GROUP BY doc_id),
o AS (SELECT doc_id, ws, coalesce(len(gone), 0) AS n_removed, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN m USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM o LEFT JOIN t USING (doc_id)"""
