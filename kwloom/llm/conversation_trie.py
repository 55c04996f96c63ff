"""The prefix trie of conversations: z-fast tries, grown in batches.

A conversation is the sequence of its turns, and known by a 128-bit hash of each prefix. A trie is
compacted: a node stands for the edge from its parent's extent to its own. Every node is filed
under the hash of its prefix at the two-fattest depth of that edge (the depth divisible by the
highest power of two), so that a binary search over depths finds the node where a conversation
leaves the trie in a logarithmic number of lookups.

The first batch is a bounded sample: its trie goes to all tasks, which locate every conversation's
exit. Conversations that leave at one point by one turn are a group; the nodes below that point are
theirs alone. A group too large for a task gives another batch to the trie. Each task grows the
tries of its groups and expands their edges to one row a node; the trie above the groups gets their
sums and is expanded last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import Sent, spread, stored, trim_memory
from kwloom.llm.hashing import RUNS, mixed, powers

#: A conversation takes up to HEADS - 1 turns from the conversation at the start of its FAMILY of ids.
FAMILY, HEADS = 20, 4
#: Turns below its exit that a group may have, unless it is one conversation.
GROUP = 1 << 16
#: Conversations of a batch: one for every GROUP / SHARE turns, within these bounds; and turns of each.
SHARE, BATCH, DEPTH = 16, (512, 1 << 16), 32
#: Ids in a block that is hashed at once.
BLOCK = 1000
WORD = "[^\\x20\\x09-\\x0D]+"
_DEPTH = np.uint64(0x9E3779B97F4A7C15)
_NODE = "p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


@dataclass
class Sequences:
    """Prefix hashes and word counts of conversations, end to end."""

    first: np.ndarray
    size: np.ndarray
    p1: np.ndarray
    p2: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Sequences:
        flat = []
        for name in ("p1", "p2", "words"):
            column = table.column(name)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            flat.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
        size = pa.compute.list_value_length(table.column("p1")).to_numpy(zero_copy_only=False) if isinstance(
            table, pa.RecordBatch) else pa.compute.list_value_length(table.column("p1")).to_numpy()
        size = size.astype(np.int64)
        return cls(np.cumsum(size) - size, size, *flat)

    @classmethod
    def prefixes(cls, whole: Sequences, rows: np.ndarray, sizes: np.ndarray) -> Sequences:
        """The first ``sizes`` turns of the sequences at ``rows``."""
        at = spread(whole.first[rows], sizes)
        return cls(np.cumsum(sizes) - sizes, sizes, whole.p1[at], whole.p2[at], whole.words[at])

    def joined(self, other: Sequences) -> Sequences:
        both = [np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("size", "p1", "p2", "words")]
        return Sequences(np.cumsum(both[0]) - both[0], *both)

    def at(self, rows: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the prefix of each of ``rows`` at ``depth``, 1 at least."""
        i = self.first[rows] + depth - 1
        return self.p1[i], self.p2[i]


def two_fattest(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The number in (low, high] that the highest power of two divides."""
    power = np.frexp((low ^ high).astype(float))[1] - 1
    return (high >> power) << power


class Filed:
    """Numbers filed under 128-bit keys."""

    def __init__(self, p1: np.ndarray, p2: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(p1, kind="stable")
        self.p1, self.p2, self.values = p1[order], p2[order], values[order]

    def find(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """The number filed under each key, or -1."""
        if not len(self.p1):
            return np.full(len(p1), -1)
        at = np.minimum(np.searchsorted(self.p1, p1), len(self.p1) - 1)
        return np.where((self.p1[at] == p1) & (self.p2[at] == p2), self.values[at], -1)


class Trie:
    """A z-fast trie of sequences; node 0 is the root, every other the edge (low, high] of its ``rep``."""

    def __init__(self, sequences: Sequences, batch: np.ndarray | None = None) -> None:
        self.sequences = sequences
        self.rep, self.low, self.high = (np.zeros(1, dtype=np.int64) for _ in range(3))
        self._file()
        if len(sequences.size):
            some = np.flatnonzero(sequences.size > 0) if batch is None else batch
            ends = sequences.p1[sequences.first[some] + sequences.size[some] - 1]
            self.insert(some[np.argsort(ends, kind="stable")])  # in no order: a hash decides which comes first

    def _file(self) -> None:
        nodes, seqs = np.arange(1, len(self.rep)), self.sequences
        rep, low, high = self.rep[1:], self.low[1:], self.high[1:]
        self.handles = Filed(*seqs.at(rep, two_fattest(low, high)), nodes)
        self.starts = Filed(*seqs.at(rep, low + 1), nodes)

    def locate(self, others: Sequences, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, edge, depth): for each of ``rows`` of ``others`` the edge on which it leaves the trie,
        or -1 where it does so at a node, and the depth; ``node`` is that node if there is no edge."""
        node, low, high = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), others.size[rows].copy()
        edge, least = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        left = np.flatnonzero(low < high)
        while len(left):  # fat binary search
            own, depth = rows[left], two_fattest(low[left], high[left])
            met = self.handles.find(*others.at(own, depth))
            end = self.high[met]
            fits = (met >= 0) & (end <= others.size[own])
            some = np.flatnonzero(fits)
            ours, theirs = self.sequences.at(self.rep[met[some]], end[some]), others.at(own[some], end[some])
            fits[some] = (ours[0] == theirs[0]) & (ours[1] == theirs[1])
            out, deeper = left[(met >= 0) & ~fits], left[fits]
            edge[out], least[out] = met[(met >= 0) & ~fits], depth[(met >= 0) & ~fits]
            node[deeper], low[deeper] = met[fits], end[fits]
            high[left[met < 0]] = depth[met < 0] - 1
            left = left[(low[left] < high[left]) & (edge[left] < 0)]
        depth = self.high[node].copy()
        more = np.flatnonzero((others.size[rows] > depth) & (edge < 0))
        edge[more], least[more] = self.starts.find(*others.at(rows[more], depth[more] + 1)), depth[more] + 1
        left = np.flatnonzero(edge >= 0)
        low, high = least[left], np.minimum(self.high[edge[left]], others.size[rows[left]])
        while (low < high).any():  # how far the sequence follows the edge
            middle = (low + high + 1) // 2
            ours, theirs = self.sequences.at(self.rep[edge[left]], middle), others.at(rows[left], middle)
            same = (ours[0] == theirs[0]) & (ours[1] == theirs[1])
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        depth[left] = low
        return node, edge, depth

    def insert(self, todo: np.ndarray) -> None:
        """Sequences in rounds: all edges that they leave are split, and each new branch gets its first leaf."""
        seqs = self.sequences
        while len(todo):
            _, edge, depth = self.locate(seqs, todo)
            inside = (edge >= 0) & (depth < self.high[np.maximum(edge, 0)])
            cuts = np.unique(np.stack([edge[inside], depth[inside]]), axis=1)  # by edge, then depth
            longer = np.flatnonzero(seqs.size[todo] > depth)
            _, chosen = np.unique(seqs.at(todo[longer], depth[longer] + 1)[0], return_index=True)
            leaves = longer[chosen]
            first = np.ones(cuts.shape[1], dtype=bool)
            first[1:] = cuts[0, 1:] != cuts[0, :-1]
            above = np.where(first, self.low[cuts[0]], np.roll(cuts[1], 1))
            rep = np.concatenate([self.rep, self.rep[cuts[0]], todo[leaves]])
            np.maximum.at(self.low, cuts[0], cuts[1])  # the edge keeps what lies below its last cut
            self.low = np.concatenate([self.low, above, depth[leaves]])
            self.high = np.concatenate([self.high, cuts[1], seqs.size[todo[leaves]]])
            self.rep = rep
            self._file()
            todo = np.delete(todo[longer], chosen)

    def expand(self, ends: dict[str, np.ndarray], cut: np.ndarray | None = None) -> pa.Table:
        """A row for each node of the whole trie, from what ``ends`` says of every sequence's last node.

        ``ends``: conversations there (n, conv the smallest), and what groups below add: kids,
        leaves, saved. Nodes down to ``cut`` of their sequence belong to another trie and are
        left out; ``top`` marks the first below, whose parent is there.
        """
        seqs, size = self.sequences, len(self.rep)
        node, _, _ = self.locate(seqs, np.arange(len(seqs.size)))
        n, kids, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(4))
        conv = np.full(size, np.iinfo(np.int64).max)
        for total, name in ((n, "n"), (kids, "kids"), (leaves, "leaves"), (saved, "saved")):
            np.add.at(total, node, ends[name])
        np.minimum.at(conv, node, ends["conv"])
        sums = np.concatenate([[0], np.cumsum(seqs.words)])
        extents = Filed(*seqs.at(self.rep[1:], self.high[1:]), np.arange(1, size))
        parent = np.zeros(size, dtype=np.int64)
        deep = np.flatnonzero(self.low > 0)
        parent[deep] = extents.find(*seqs.at(self.rep[deep], self.low[deep]))
        begin = seqs.first[self.rep] if len(seqs.first) else np.zeros(size, dtype=np.int64)
        text = sums[begin + self.high] - sums[begin + self.low]
        depths = np.unique(self.high[1:])[::-1]
        by_depth = np.argsort(-self.high[1:], kind="stable") + 1
        bounds = np.searchsorted(-self.high[by_depth], -depths, side="right")
        for own in np.split(by_depth, bounds[:-1]) if len(by_depth) else []:  # children before parents
            leaves[own] += kids[own] == 0
            up = parent[own]
            np.add.at(n, up, n[own])
            np.add.at(kids, up, 1)
            np.add.at(leaves, up, leaves[own])
            np.add.at(saved, up, saved[own] + (n[own] - 1) * text[own])
            np.minimum.at(conv, up, conv[own])
        leaves[0] += kids[0] == 0
        low = self.low if cut is None else np.maximum(self.low, cut[self.rep])
        length = np.maximum(self.high - low, 0)
        length[0] = 0
        of = np.repeat(np.arange(size), length)
        depth = spread(low + 1, length).astype(np.int64)
        p1, p2 = seqs.at(self.rep[of], depth)
        rest = sums[begin[of] + self.high[of]] - sums[begin[of] + depth - 1]
        inner, start = depth < self.high[of], depth == self.low[of] + 1
        top = np.zeros(len(of), dtype=bool) if cut is None else depth == cut[self.rep[of]] + 1
        columns = {
            "p1": p1, "p2": p2, "depth": depth, "conv_id": conv[of], "parent_conv_id": np.where(start, conv[parent[of]], conv[of]),
            "n_convs": n[of], "n_children": np.where(inner, 1, kids[of]), "n_leaves": leaves[of],
            "saved_tokens": saved[of] + (n[of] - 1) * rest,
        }
        held = {k: pa.array(v) for k, v in columns.items()}
        held["parent_conv_id"] = pa.array(columns["parent_conv_id"], mask=top)
        held["top"], held["row"] = pa.array(top), pa.array(self.rep[of])
        table = pa.table(held)
        if cut is None:
            root = {"p1": 0, "p2": 0, "depth": 0, "conv_id": conv[0], "parent_conv_id": None, "n_convs": n[0], "n_children": kids[0]}
            root |= {"n_leaves": leaves[0], "saved_tokens": saved[0], "top": False, "row": 0}
            table = pa.concat_tables([table, pa.Table.from_pylist([root], schema=table.schema)])
        return table


def _hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, e1, e2, p1, p2, words) of (conv_id, h1, h2, words): hashes of the prefixes; e, of the last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h1")
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            depth = np.arange(int(size.sum())) - np.repeat(first, size)
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            out, last = [], []
            for name, factor in (("h1", RUNS[0]), ("h2", RUNS[1])):
                turn = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                steps = powers(factor, int(size.max(initial=0)) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turn * steps[depth], dtype=np.uint64)])
                prefix = total[1:] - np.repeat(total[first], size)
                prefix = mixed(prefix + (depth + 1).astype(np.uint64) * _DEPTH).view(np.int64)
                end = np.zeros(len(size), dtype=np.int64)
                end[size > 0] = prefix[(first + size - 1)[size > 0]]
                out.append(pa.ListArray.from_arrays(ends, pa.array(prefix)))
                last.append(pa.array(end))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *last, *out, batch.column("words")], names=["conv_id", "e1", "e2", "p1", "p2", "words"]
            )

    return rows.mapInArrow(run, "conv_id long, e1 long, e2 long, p1 array<long>, p2 array<long>, words array<int>")


def rebuilt(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    family: int = FAMILY, heads: int = HEADS,
) -> DataFrame:
    """(conv_id, e1, e2, p1, p2, words): every rebuilt conversation by the hashes of its prefixes.

    The first h turns, h from the id's crc32, come from the conversation at the start of the
    id's family; the others are its own after its first h. Texts are hashed before anything is
    shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turn = F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(11), role, text).alias("h2"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).where(F.col("conv_id").isNotNull())
    own = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")))  # one conversation
    base = F.col("conv_id") - F.col("conv_id") % family
    head = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    whole = own.withColumn("base", base).join(head, "base", "left").select(
        "conv_id", F.concat(
            F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own"))
        ).alias("own"),
    )
    return _hashed(whole.select("conv_id", "own.h1", "own.h2", "own.words"))


def ends_digests(convs: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): SHA-256 of the sorted ids of the conversations that end at each node.

    The ids are sorted in ranges and joined in blocks; what one task then hashes, block after
    block, holds a thousandth of the rows and never all of them.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e1, e2, ids = (batch.column(c).to_numpy() for c in ("e1", "e2", "conv_id"))
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
            start = np.flatnonzero(new)
            start = np.unique(np.concatenate([start, np.arange(0, len(ids), BLOCK)]))
            names = ids.astype(str).tolist()
            joined = [",".join(names[a:b]) for a, b in zip(start, [*start[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(e1[start]), pa.array(e2[start]), pa.array(ids[start]), pa.array(joined, pa.string())],
                names=["p1", "p2", "first", "ids"],
            )

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["p1", "p2", "ends_sha256"])
        if key is not None:
            last = [*key, state.hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], names=["p1", "p2", "ends_sha256"])

    keys = ["e1", "e2", "conv_id"]
    joined = convs.select(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        blocks, "p1 long, p2 long, first long, ids string"
    )
    return joined.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(
        digest, "p1 long, p2 long, ends_sha256 string"
    )


def _routed(seqs: DataFrame, batches_so_far: Sent) -> DataFrame:
    """``seqs`` with ``cut``, where each leaves the trie, its prefix there (u1, u2) and the group (g1, g2) below, if any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = batches_so_far.value
        for batch in batches:
            others = Sequences.of(batch)
            rows = np.arange(len(others.size))
            _, _, cut = trie.locate(others, rows)
            u, g = [np.zeros(len(rows), np.int64) for _ in range(2)], [np.zeros(len(rows), np.int64) for _ in range(2)]
            on, off = np.flatnonzero(cut > 0), np.flatnonzero(others.size > cut)
            for held, some, depth in ((u, on, cut[on]), (g, off, cut[off] + 1)):
                held[0][some], held[1][some] = others.at(some, depth)
            none = np.ones(len(rows), dtype=bool)
            none[off] = False
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cut), *map(pa.array, u), *(pa.array(x, mask=none) for x in g)],
                names=[*batch.schema.names, "cut", "u1", "u2", "g1", "g2"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seqs.schema)
    return seqs.mapInArrow(run, f"{kinds}, cut long, u1 long, u2 long, g1 long, g2 long")


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    family: int = FAMILY, heads: int = HEADS, group: int = GROUP, batch: tuple[int, int] = BATCH, depth: int = DEPTH,
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one (depth 0) included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    Turns are ordered by number, null first; turns of one number by role, then by a hash of the
    text (repeated rows are turns of their own). Null roles and texts are empty. Rows with a
    null id are no conversation. A conversation without turns is a member of the root. An
    empty table has no conversation and gives no rows. Copies are one sequence with a count; a
    conversation is one row of hashes, 24 bytes a turn. Turns are told apart by 128 bits. Other
    columns are not read.
    """
    convs = stored(rebuilt(df, conv_col, turn_col, role_col, text_col, family, heads))
    copies = convs.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    seqs = stored(convs.join(copies.select("conv_id", "n"), "conv_id"))
    turns = seqs.agg(F.sum(F.size("p1"))).first()[0]
    if turns is None:
        return df.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, "
                                               "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    take = int(min(max(SHARE * turns // group, batch[0]), batch[1]))
    sampled = Trie(Sequences(*(np.zeros(0, dtype=np.int64) for _ in range(5))))
    more = seqs.withColumn("upto", F.lit(depth))
    while True:  # every batch divides the groups that are still too large
        upto = [F.slice(c, F.lit(1), F.col("upto").cast("int")).alias(c) for c in ("p1", "p2", "words")]
        chosen = more.where("size(p1) > 0").orderBy("e1", "e2").limit(take).select(*upto).toArrow()
        sequences = sampled.sequences.joined(Sequences.of(chosen)) if chosen.num_rows else sampled.sequences
        sampled = Trie(sequences)
        sent = Sent(df.sparkSession, sampled)
        routed = _routed(seqs, sent)
        below = F.size("p1") - F.col("cut")
        groups = routed.where("g1 is not null").groupBy("g1", "g2").agg(F.sum(below).alias("below"), F.count(F.lit(1)).alias("members"))
        large = stored(groups.where((F.col("below") > group) & (F.col("members") > 1)))
        if not large.limit(1).count():
            break
        more = routed.join(large.select("g1", "g2"), ["g1", "g2"], "left_semi").withColumn("upto", F.col("cut") + depth)

    def grown(rows: pa.Table) -> pa.Table:
        seqs = Sequences.of(rows)
        none = np.zeros(len(seqs.size), dtype=np.int64)
        own = {"n": rows.column("n").to_numpy(), "conv": rows.column("conv_id").to_numpy()}
        table = Trie(seqs).expand(own | {"kids": none, "leaves": none, "saved": none}, rows.column("cut").to_numpy())
        at = table.column("row")
        table = table.drop_columns(["row"])
        for name in ("cut", "u1", "u2"):
            table = table.append_column(name, rows.column(name).take(at))
        trim_memory()
        return table

    def topped(rows: pa.Table) -> pa.Table:
        whole = sent.value.sequences
        depths = np.arange(len(whole.p1)) - np.repeat(whole.first, whole.size) + 1
        where = Filed(whole.p1, whole.p2, np.arange(len(whole.p1)))
        at = where.find(rows.column("u1").to_numpy(), rows.column("u2").to_numpy())
        size = np.where(at >= 0, depths[at] if len(depths) else 0, 0)
        of = np.repeat(np.arange(len(whole.size)), whole.size)
        prefixes = Sequences.prefixes(whole, of[at] if len(of) else at, size)
        names = {"n": "n_convs", "conv": "conv_id", "kids": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
        return Trie(prefixes).expand({k: rows.column(c).to_numpy() for k, c in names.items()}).drop_columns(["row", "top"])

    buckets = max(int(turns // group) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets))
    low = stored(
        routed.where("g1 is not null").select("conv_id", "n", "p1", "p2", "words", "cut", "u1", "u2", bucket.alias("bucket"))
        .groupBy("bucket").applyInArrow(grown, f"{_NODE}, top boolean, cut long, u1 long, u2 long")
    )
    # what lies below each point of the sampled trie where conversations leave or end
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ending = routed.where("g1 is null").select(
        "u1", "u2", "conv_id", F.col("n").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens"))
    )
    leaving = low.where("top").select("u1", "u2", "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    points = ending.union(leaving).groupBy("u1", "u2").agg(F.min("conv_id").alias("conv_id"), *sums)
    high = stored(points.groupBy(F.lit(0).alias("all")).applyInArrow(topped, _NODE))  # as many rows as the sample has turns, at most
    parents = high.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("above"))
    names = [c.split()[0] for c in _NODE.split(", ")]
    tops = low.where("top").join(parents, ["u1", "u2"], "left").withColumn("parent_conv_id", F.col("above"))
    nodes = high.select(names).union(low.where("not top").select(names)).union(tops.select(names))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends_digests(convs), ["p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def duckdb_sql(family: int = FAMILY, heads: int = HEADS) -> str:
    """The rows of :func:`prefix_trie` over ``conversations`` in DuckDB SQL: all prefixes, grouped."""
    step = "list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, ascii(b)::BIGINT))"
    crc = f"xor(list_reduce(string_split(conv_id::VARCHAR, ''), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
z AS (SELECT conv_id, count(*) AS turns FROM o GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % {family} AS base, {crc} % {heads} AS h FROM z),
g AS (SELECT c.*, least(h, coalesce(z.turns, 0)) AS m FROM c LEFT JOIN z ON z.conv_id = base),
q AS (SELECT g.conv_id, o.k AS d, role, text FROM g JOIN o ON o.conv_id = base AND k <= h
      UNION ALL SELECT g.conv_id, m + k - h, role, text FROM g JOIN o USING (conv_id) WHERE k > h),
x AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
             string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM q
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w FROM x GROUP BY p, d),
l AS (SELECT conv_id, arg_max(p, d) AS p FROM x GROUP BY conv_id),
e AS (SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY p),
k AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (p)),
a AS (SELECT left(p, 32 * u) AS p, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM v) GROUP BY 1)
SELECT v.conv_id::BIGINT AS conv_id, v.d::BIGINT AS depth, r.conv_id::BIGINT AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
       kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM v JOIN a USING (p) LEFT JOIN e USING (p) LEFT JOIN n r ON v.d > 0 AND r.p = left(v.p, 32 * (v.d - 1))"""
