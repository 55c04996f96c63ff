"""Byte-level BPE: every text to token ids and back, in padded matrices of one length each."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import Sent, sliced, spread, trim_memory

NO_RANK = np.int32(2**31 - 1)
#: Cells of one padded matrix; more rows of a length go into the next one.
CELLS = 1 << 18
#: Words a task remembers; when full, it starts anew.
REMEMBERED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, where each token's start, and how many it has."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


@dataclass
class Vocabulary:
    """A vocabulary for encoding: ranks, and a hash table of mergeable pairs."""

    ranks: dict[bytes, int]
    of_byte: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> Vocabulary:
        of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {
            (left << 32) | right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None
            and (right := ranks.get(token[cut:])) is not None
        }
        slots = 1 << max(4, (4 * len(pairs)).bit_length())
        keys, values = np.full(slots, -1, dtype=np.int64), np.full(slots, NO_RANK, dtype=np.int32)
        left_over = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        ranked = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at = _slot(left_over, slots)
        while len(left_over):  # linear probing: of those that want a free slot the first one gets it
            free = np.flatnonzero(keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            keys[at[won]], values[at[won]] = left_over[won], ranked[won]
            rest = np.ones(len(at), dtype=bool)
            rest[won] = False
            left_over, ranked, at = left_over[rest], ranked[rest], (at[rest] + 1) & (slots - 1)
        return cls(ranks, of_byte, keys, values)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, ``NO_RANK`` where it is no token; -1 marks padding."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = _slot(key, len(self.keys))
        there = self.keys[at]
        out = np.where(there == key, self.values[at], NO_RANK)
        open_ = np.nonzero((there != key) & (there >= 0))
        key, at = key[open_], at[open_]
        while len(key):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == key
            out[tuple(x[hit] for x in open_)] = self.values[at[hit]]
            go = ~hit & (there >= 0)
            open_, key, at = tuple(x[go] for x in open_), key[go], at[go]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out

    def merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final ids (end to end) and their counts, of rows of byte tokens padded with -1.

        Each round every row merges its leftmost pair of least rank and closes the gap;
        rows without a mergeable pair leave the matrix.
        """
        rows = np.arange(len(ids))
        counts = np.zeros(len(ids), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] == 1:
                done.append((rows, ids))
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            over = best == NO_RANK
            if over.any():
                done.append((rows[over], ids[over]))
                go = ~over
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
            line = np.arange(len(at))
            keep = np.arange(ids.shape[1] - 1)[None, :] <= at[:, None]
            ids[line, at] = best
            ids = np.where(keep, ids[:, :-1], ids[:, 1:])
            ranks = np.where(keep[:, :-1], ranks[:, :-1], ranks[:, 1:])
            if ids.shape[1] > 1:
                for side in (at - 1, at):
                    fits = (side >= 0) & (side < ids.shape[1] - 1)
                    r, c = line[fits], side[fits]
                    ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
        for of, part in done:
            counts[of] = (part >= 0).sum(axis=1)
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        for of, part in done:
            flat[spread(starts[of], counts[of])] = part[part >= 0]
        return flat, counts

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces end to end, and their counts; a piece that is a token is that token."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        begins = np.cumsum(sizes) - sizes
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        counts = np.where(whole >= 0, 1, 0)
        widths = np.where(sizes <= 32, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        widths[whole >= 0] = 0
        order = np.argsort(widths, kind="stable")
        edges = np.searchsorted(widths[order], np.unique(widths), side="left").tolist() + [len(order)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            width = int(widths[order[low]])
            if not width:
                continue
            step = max(1, CELLS // width)
            for begin in range(low, high, step):
                some = order[begin:min(high, begin + step)]
                lengths = sizes[some]
                padded = np.full((len(some), int(lengths.max())), -1, dtype=np.int32)
                padded[np.arange(padded.shape[1])[None, :] < lengths[:, None]] = data[spread(begins[some], lengths)]
                flat, counts[some] = self.merged(padded)
                done.append((some, flat))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        out[starts[whole >= 0]] = whole[whole >= 0]
        for some, flat in done:
            out[spread(starts[some], counts[some])] = flat
        return out, counts


class Words:
    """Token ids of texts, by way of the distinct words of a batch.

    Where single spaces are the only spaces, a space and what follows it up to the next
    space is encoded alike everywhere; other texts are cut as a whole.
    """

    def __init__(self, vocab: Vocabulary, cut: regex.Pattern) -> None:
        self.vocab, self.cut = vocab, cut
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = (np.zeros(0, dtype=np.int32), *np.zeros((2, 0), dtype=np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and their counts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pa.compute.match_substring_regex(texts, r"[\s\pZ\x0b\x1c-\x1f\x85] | [\s\pZ\x0b\x1c-\x1f\x85]| $|^ ")
        plain = pa.compute.if_else(odd, pa.scalar("", pa.large_string()), texts)
        parts = pa.compute.split_pattern(plain, " ")
        per_text = pa.compute.list_value_length(parts).to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        #: a word after a space is keyed by itself, a first word or an odd text with a space before
        keys = coded.dictionary.to_pylist()
        firsts = np.cumsum(per_text) - per_text
        is_odd = odd.to_numpy(zero_copy_only=False)
        extra: dict[str, int] = {}
        first_keys = [keys[c] for c in codes[firsts]]
        for i in np.flatnonzero(is_odd):
            first_keys[i] = texts[int(i)].as_py()
        codes[firsts] = [extra.setdefault(k, len(keys) + len(extra)) for k in first_keys]
        used = np.unique(codes)
        names = [*keys, *(" " + k for k in extra)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.flat, self.starts, self.counts = self.flat[:0], self.starts[:0], self.counts[:0]
        self._learn([names[c] for c in used if names[c] not in self.known])
        at = np.zeros(len(names), dtype=np.int64)
        at[used] = [self.known[names[c]] for c in used]
        at = at[codes]
        counts = self.counts[at]
        ids = self.flat[spread(self.starts[at], counts)]
        return ids, np.add.reduceat(counts, firsts) if len(firsts) else counts

    def _learn(self, names: list[str]) -> None:
        """Encode words not met before; a name that starts with a space stands for its rest."""
        found = [self.cut.findall(n[1:] if n[:1] == " " else " " + n) for n in names]
        per_name = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pieces: dict[str, int] = {}
        codes = np.array([pieces.setdefault(p, len(pieces)) for x in found for p in x], dtype=np.int64)
        flat, sizes = self.vocab.encode_pieces([p.encode() for p in pieces])
        begins = np.cumsum(sizes) - sizes
        ids = flat[spread(begins[codes], sizes[codes])]
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        edges = total[np.concatenate([[0], np.cumsum(per_name)])]
        self.known.update((n, len(self.starts) + i) for i, n in enumerate(names))
        self.starts = np.concatenate([self.starts, edges[:-1] + len(self.flat)])
        self.counts = np.concatenate([self.counts, np.diff(edges)])
        self.flat = np.concatenate([self.flat, ids])


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    spun = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spun >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, token_ids): the token ids of every whole text.

    Matches of ``pattern`` are encoded separately, without special tokens. Null and empty
    texts give an empty array; repeated rows give one row each; rows with a null id are kept.
    A very long text is one row of work: memory is in proportion to the longest text. The
    vocabulary file is read on the driver and sent to the tasks; its size is fixed.
    """
    vocabulary = Sent(df.sparkSession, Vocabulary.build(read_ranks(ranks_path)))
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary.value, regex.compile(pattern))
        for batch in sliced(batches, "text", 1 << 20):
            ids, counts = words.encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "token_ids"])
        words = batch = lists = ids = counts = None
        trim_memory()

    return chosen.mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids in ``out_col``; a null array gives no bytes.

    An id outside the vocabulary fails the query. Other columns pass through.
    """
    tokens = Sent(df.sparkSession, token_bytes(read_ranks(ranks_path)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, starts, lengths = tokens.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                lists = batch.column(ids_col)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                data = blob[spread(starts[ids], lengths[ids])] if len(ids) else np.zeros(0, dtype=np.uint8)
                per_token = np.concatenate([[0], np.cumsum(lengths[ids])]) if len(ids) else np.zeros(1, dtype=np.int64)
                offsets = per_token[np.concatenate([[0], np.cumsum(counts)])]
                value = pa.Array.from_buffers(
                    pa.binary(), len(counts),
                    [None, pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(data.tobytes())],
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, out_col])
        whole = batch = lists = ids = data = value = None
        trim_memory()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out_col}` binary")


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    tokens = decode(encode(df, ranks_path, pattern), ranks_path)
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
