"""The prefix trie against brute force: on the given conversations, on odd rows, in many batches."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kwloom.llm import conversation_trie as ct

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string, n long, p1 string"


def brute(rows):
    """One tuple of COLUMNS for each prefix, from sets of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h]
        path = tuple(t[1:] for t in [*head, *turns[h:]])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids.get(path, 0)
            saved[path[:d]] += (len(of) - 1) * words
    return sorted(
        (
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of), kids.get(path, 0), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, ())))).encode()).hexdigest(),
        )
        for path, of in members.items()
    )


def found(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def key(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], r[7]))


SMALL = {"group": 200, "batch": (8, 12), "depth": 16}


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_odd_rows(spark, limits):
    rng = random.Random(4)
    rows = [(c, t, r, x) for c in range(-45, 130) if c != 60 for t, (r, x) in enumerate(
        (rng.choice(["user", None]), rng.choice(["a b", "c", None, "é\x1f x\ty"])) for _ in range(rng.choice([1, 2, 3, 5])))]
    rows += [(200 + i, t, "user", f"w {t}") for i in range(40) for t in range(4)]  # copies, but for their heads
    rows += [(500 + i, None, "user", "no number") for i in range(3)] + [(500, 2, "b", "tie"), (500, 2, "a", "tie"), (500, 2, "a", "tie")]
    rows += [(None, 1, "user", "no id"), (61, 9, None, None), (1000, 0, "user", "word " * 3000)]
    rows += [(2000, t, "user", "long") for t in range(300)] + [(2001, t, "user", "long") for t in range(280)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).repartition(3)
    got = found(ct.prefix_trie(df.where("conv_id is not null or text is not null"), **limits))
    assert key(got) == key(brute(rows))
    assert ct.prefix_trie(df.limit(0)).count() == 0
    assert ct.prefix_trie(df.where("conv_id is null")).count() == 0


def test_given_conversations_in_many_batches(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in df.collect()]
    assert key(found(ct.prefix_trie(df, group=20, batch=(3, 3), depth=3))) == key(brute(rows))


def test_many_copies_and_turnless(spark):
    rows = [(20 * i + 7, 0, "user", "same text") for i in range(3000)]  # no conversation at the start of a family
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).repartition(5)
    got = found(ct.prefix_trie(df))
    assert key(got) == key(brute(rows))
    assert len(got) == 2 and got[0][0] == 7


def test_z_fast_trie_finds_every_exit():
    rng = np.random.default_rng(0)
    turns = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(400)]
    turns += [[0] * k for k in range(1, 60)] + [[0] * k + [1] for k in range(60)]
    turns = list({tuple(t): None for t in turns})

    def sequences(some):
        p = [[hash(t[:d + 1]) for d in range(len(t))] for t in some]
        size = np.array([len(t) for t in some])
        flat = np.array([x for q in p for x in q], dtype=np.int64)
        return ct.Sequences(np.cumsum(size) - size, size, flat, flat * 3, np.ones(len(flat), dtype=np.int64))

    inside, outside = turns[::2], turns[1::2]
    trie = ct.Trie(sequences(inside))
    have = {t[:d] for t in inside for d in range(len(t) + 1)}
    _, _, depth = trie.locate(sequences(outside), np.arange(len(outside)))
    assert depth.tolist() == [max(d for d in range(len(t) + 1) if t[:d] in have) for t in outside]
    assert len(trie.rep) <= 2 * len(inside)
    low, high = np.array([0, 0, 4, 5, 8, 10]), np.array([1, 7, 6, 8, 9, 63])
    assert ct.two_fattest(low, high).tolist() == [1, 4, 6, 8, 9, 32]
