"""Lines that many documents have, dropped from all but one: a sharded minimal perfect hash.

Every long line is known by 128 bits of its key. Spark counts the documents of each distinct line
hash; those of two documents or more go to shards by their leading bits. A task makes the minimal
perfect hash of one shard (levels of bits; a key that is alone at its place stays there, the rest
goes to the next level), which numbers its keys without gaps. The numbers index plain arrays of
fingerprints, counts and keepers. Documents then probe the arrays; no line is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import Sent, sliced, stored, trim_memory
from kwloom.llm.hashing import mixed

#: Lines of fewer code points are left alone, and lines of fewer documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys of a shard, about.
SHARD = 1 << 15
#: An index of at most so many bytes goes to every task; the probes of a larger one go to its shards.
SENT = 16 << 20
#: Probes of a shard that one task takes, about: a shard with a line of very many documents has several.
PROBES = 1 << 18
#: Bytes of text split at a time.
PIECE = 2 << 20
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)
_SPACE = " \t\n\v\f\r"


@dataclass
class Shard:
    """A minimal perfect hash and the arrays that it indexes."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]
    prints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @staticmethod
    def _places(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        spun = mixed(k1 + k2 * (_LEVEL + np.uint64(2 * level)))
        return (spun % np.uint64(size)).astype(np.int64)

    @classmethod
    def number(cls, k1: np.ndarray, k2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The bits of each level, and the number of each of the distinct keys (k1, k2)."""
        out, left, base, bits = np.empty(len(k1), dtype=np.int64), np.arange(len(k1)), 0, []
        while len(left):
            size = 8 * (len(left) // 4 + 1)  # two bits a key, whole bytes
            at = cls._places(k1[left], k2[left], len(bits), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, dtype=bool)
            level[at[alone]] = True
            out[left[alone]] = base + (np.cumsum(level) - 1)[at[alone]]
            base += int(alone.sum())
            left = left[~alone]
            bits.append(np.packbits(level, bitorder="little"))
        return bits, out

    @classmethod
    def read(cls, levels: list[bytes], prints: bytes, counts: bytes, keepers: bytes) -> Shard:
        held, base = [], 0
        for raw in levels:
            packed = np.frombuffer(raw, dtype=np.uint8)
            ones = _ONES[packed]
            held.append((8 * len(packed), packed, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
        return cls(held, np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(keepers, np.int64))

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that is not in the shard."""
        out, left = np.full(len(k1), -1, dtype=np.int64), np.arange(len(k1))
        for level, (size, packed, before) in enumerate(self.levels):
            at = self._places(k1[left], k2[left], level, size)
            byte, bit = packed[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 > 0
            under = byte[hit] & ((1 << bit[hit].astype(np.int64)) - 1).astype(np.uint8)
            out[left[hit]] = before[at[hit] >> 3] + _ONES[under]
            left = left[~hit]
        some = out >= 0
        some[some] = self.prints[out[some]] == k2[some]
        return np.where(some, out, -1)

    def drops(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
        """Whether ``least`` documents or more have the line and another one keeps it."""
        at = self.find(k1, k2)
        out = at >= 0
        out[out] = (self.counts[at[out]] >= least) & (self.keepers[at[out]] != doc[out])
        return out


class Lines:
    """The lines of a batch of texts, and the 128-bit keys of the long ones."""

    def __init__(self, texts: pa.Array, least: int) -> None:
        lists = pa.compute.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
        self.text = lists.flatten()
        self.per_doc = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.per_doc)
        keys = pa.compute.ascii_lower(pa.compute.ascii_trim(self.text, characters=_SPACE))
        long = pa.compute.greater_equal(pa.compute.utf8_length(keys), least)
        self.at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        raw = keys.filter(long).cast(pa.large_binary()).to_pylist()
        pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), dtype=np.uint64).reshape(-1, 2)
        self.k1, self.k2 = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def without(self, gone: np.ndarray) -> pa.RecordBatch:
        """(n_lines, n_dropped, kept) of each text, without the lines at ``gone``."""
        keep = np.ones(len(self.doc), dtype=bool)
        keep[gone] = False
        dropped = np.bincount(self.doc[~keep], minlength=len(self.per_doc))
        ends = np.concatenate([[0], np.cumsum(self.per_doc - dropped)])
        rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.text.filter(pa.array(keep)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.per_doc, pa.int64()), pa.array(dropped, pa.int64()),
                pa.compute.binary_join(rest, pa.scalar("\n", pa.large_string())).cast(pa.string()),
            ],
            names=["n_lines", "n_dropped", "kept"],
        )


def _shard_of(k1: np.ndarray, bits: int) -> np.ndarray:
    return (k1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k1), dtype=np.int64)


def _keys(docs: DataFrame, least_chars: int, bits: int = 0) -> DataFrame:
    """(shard, k1, k2, doc_id): the distinct long lines of each text of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", PIECE):
            lines = Lines(batch.column("text"), least_chars)
            ids = batch.column("doc_id").to_numpy()[lines.doc[lines.at]]
            order = np.lexsort((ids, lines.k2, lines.k1))
            columns = [x[order] for x in (lines.k1, lines.k2, ids)]
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            k1, k2, ids = (c[new] for c in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (_shard_of(k1, bits), k1.view(np.int64), k2.view(np.int64), ids)],
                names=["shard", "k1", "k2", "doc_id"],
            )
        trim_memory()

    return docs.mapInArrow(run, "shard long, k1 long, k2 long, doc_id long")


def line_counts(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, n, keeper): documents of each long line that two or more have, and the largest id.

    Documents are told apart before lines are counted, and counts are combined before they are
    shuffled, so that a line of a third of all documents sends each task a few rows.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return (
        _keys(known, least_chars).groupBy("k1", "k2")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where("n > 1")
    )


def line_index(counts: DataFrame, bits: int) -> DataFrame:
    """(shard, probes, levels, prints, counts, keepers): the index of each of 2**``bits`` shards with a line.

    ``probes`` is how many documents have a line of the shard, each line on its own.
    """
    shard = F.shiftrightunsigned("k1", 64 - bits) if bits else F.lit(0).cast("long")

    def run(rows: pa.Table) -> pa.Table:
        k1, k2, n, keeper = (rows.column(c).to_numpy() for c in ("k1", "k2", "n", "keeper"))
        k1, k2 = k1.view(np.uint64), k2.view(np.uint64)
        levels, at = Shard.number(k1, k2)
        prints, counted, keepers = np.empty_like(k2), np.empty(len(k1), np.uint32), np.empty_like(keeper)
        prints[at], counted[at], keepers[at] = k2, np.minimum(n, 2**32 - 1), keeper
        return pa.table({
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "probes": pa.array([int(n.sum())], pa.int64()),
            "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
            "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counted.tobytes()], pa.binary()),
            "keepers": pa.array([keepers.tobytes()], pa.binary()),
        })

    schema = "shard long, probes long, levels array<binary>, prints binary, counts binary, keepers binary"
    return counts.withColumn("shard", shard).groupBy("shard").applyInArrow(run, schema)


def _probed_here(docs: DataFrame, index: DataFrame, bits: int, least_chars: int, least_docs: int) -> DataFrame:
    """Every task has the whole index, which is small."""
    columns = ["levels", "prints", "counts", "keepers"]
    sent = Sent(docs.sparkSession, {r.shard: tuple(r[c] for c in columns) for r in index.collect()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {shard: Shard.read(*parts) for shard, parts in sent.value.items()}
        for batch in sliced(batches, "text", PIECE):
            lines = Lines(batch.column("text"), least_chars)
            ids = batch.column("doc_id")
            doc = ids.fill_null(0).to_numpy()[lines.doc[lines.at]]
            of, gone = _shard_of(lines.k1, bits), np.zeros(len(lines.at), dtype=bool)
            for shard in np.unique(of).tolist():
                if shard in shards:
                    own = np.flatnonzero(of == shard)
                    gone[own] = shards[shard].drops(lines.k1[own], lines.k2[own], doc[own], least_docs)
            gone &= ids.is_valid().to_numpy(zero_copy_only=False)[lines.doc[lines.at]]
            rest = lines.without(lines.at[gone])
            yield pa.RecordBatch.from_arrays([ids, *rest.columns], names=["doc_id", *rest.schema.names])
        trim_memory()

    return docs.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def _probed_there(docs: DataFrame, index: DataFrame, bits: int, least_chars: int, least_docs: int) -> DataFrame:
    """The keys of the documents go to the shards; the keys that drop come back to their documents."""
    parts = F.ceil(F.col("probes") / PROBES)
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    probes = _keys(known, least_chars, bits).join(index.select("shard", parts.alias("parts")), "shard")
    probes = probes.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))

    def run(rows: pa.Table, arrays: pa.Table) -> pa.Table:
        if not arrays.num_rows:
            return rows.select(["doc_id", "k1", "k2"]).slice(0, 0)
        shard = Shard.read(*(arrays.column(c)[0].as_py() for c in ("levels", "prints", "counts", "keepers")))
        k1, k2, doc = (rows.column(c).to_numpy() for c in ("k1", "k2", "doc_id"))
        gone = shard.drops(k1.view(np.uint64), k2.view(np.uint64), doc, least_docs)
        return rows.select(["doc_id", "k1", "k2"]).filter(pa.array(gone))

    dropped = (
        probes.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part"))
        .applyInArrow(run, "doc_id long, k1 long, k2 long")
        .groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("gone"))  # lines of one document
    )
    marked = docs.join(dropped, "doc_id", "left").select("doc_id", "text", "gone.k1", "gone.k2")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", PIECE):
            lines = Lines(batch.column("text"), least_chars)
            # the key and its row in the batch make one number a line: the keys of a row are few
            held = [batch.column(c) for c in ("k1", "k2")]
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(held[0]).fill_null(0).to_numpy(zero_copy_only=False))
            k1, k2 = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in held)
            gone = set(zip(of.tolist(), k1.tolist(), k2.tolist(), strict=True))
            asked = zip(lines.doc[lines.at].tolist(), lines.k1.view(np.int64).tolist(), lines.k2.view(np.int64).tolist(), strict=True)
            hit = np.fromiter((x in gone for x in asked), dtype=bool, count=len(lines.at))
            rest = lines.without(lines.at[hit])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rest.columns], names=["doc_id", *rest.schema.names])
        trim_memory()

    return marked.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup_lines(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
    least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, sent: int = SENT, shard: int = SHARD,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept): every document without the lines that many documents have.

    A text is split at line feeds. A line's key is the line without ASCII white space at its ends,
    A-Z in lower case. Keys of at least ``least_chars`` code points that at least ``least_docs``
    documents have lose all their lines, but for those of the largest id that has the key; ``kept``
    joins the others by a line feed, unchanged. Null and empty texts are one empty line. A key
    repeated in a document counts once and goes or stays as a whole. Rows that share an id are one
    document; a row with a null id is no document, counts nothing and keeps all its lines. An empty
    table gives no rows. Ids are whole numbers. Lines are told apart by 128 bits (64 of them are
    the fingerprint), never by less. Other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = stored(line_counts(docs, least_chars))
    bits = max(0, int(counts.count() // shard).bit_length())
    index = stored(line_index(counts, bits))
    held = F.length("prints") + F.length("counts") + F.length("keepers")
    size = index.agg(F.sum(held)).first()[0] or 0
    probed = _probed_here if size <= sent else _probed_there
    return probed(docs, index, bits, least_chars, least_docs).withColumnRenamed("doc_id", id_col)


def duckdb_sql(least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> str:
    """The digests of :func:`dedup_lines` over ``documents`` in DuckDB SQL, by a join of lines."""
    space = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, {space}), '{upper}', '{lower}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {least_chars}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {least_docs}),
m AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
