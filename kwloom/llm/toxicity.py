"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as a vector of its own and a mean of vectors of its character trigrams. The
windows of a text that start at each of its words are all scored; the text's score is that of its
highest window, in training (where the label is the text's) as in scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import Sent, fold, sample_ids, sliced
from kwloom.llm.hashing import mixed

#: Words of a window; one starts at every word that has so many from there on.
WINDOW = 6
#: Labelled texts learned from, toxic and clean, each of at most so many characters.
TOXIC, CLEAN, CHARS = 1500, 3000, 20_000
#: Vectors: of words known (in three texts at least), of trigram slots, their sizes, hidden units, attention units.
VOCABULARY, TRIGRAMS, WORD, CHAR, HIDDEN, ATTENTION = 20_000, 4096, 12, 12, 8, 8
#: Epochs on windows at random, then on each text's highest window; texts of a step; learning rate.
WARM, EPOCHS, BATCH, RATE = 4, 18, 64, 0.01
#: Epochs on the same highest windows before all windows are scored again.
AGAIN = 3
#: Share of words shown as unknown in training.
UNKNOWN = 0.15
#: Words a task remembers, and windows it scores at a time.
REMEMBERED, AT_ONCE = 120_000, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character trigrams of ``^word$``, end to end, and how many each word has."""
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    key = (letters[:-2] << np.uint64(42)) ^ (letters[1:-1] << np.uint64(21)) ^ letters[2:]
    inside = np.ones(len(key) + 2, dtype=bool)
    ends = np.cumsum(counts + 2)
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that run into the next word
    return (mixed(key[inside[:-2]]) % np.uint64(TRIGRAMS)).astype(np.int32), counts


def windows(counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word in it) of all windows of texts of so many words; a short text is one window."""
    per_text = np.where(counts > 0, np.maximum(0, counts - window) + 1, 0)
    text = np.repeat(np.arange(len(counts)), per_text)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)


@dataclass
class Network:
    """Parameters by name: vectors, a gated unit for each direction (f, b), attention and output."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    #: Share of toxic texts among the labelled ones: the score of a text without words.
    base: float = 0.5

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 4) -> Network:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * (0.1 if shape[0] > 256 else shape[0] ** -0.5)).astype(np.float32)

        p = {"word": drawn(len(vocabulary) + 1, WORD), "char": drawn(TRIGRAMS, CHAR)}
        if len(p["word"]) <= 256:
            p["word"] *= 0.1
        for side in "fb":
            p["W" + side] = drawn(WORD + CHAR, 3 * HIDDEN)
            p["U" + side] = drawn(HIDDEN, 3 * HIDDEN)
            p["c" + side] = np.zeros(3 * HIDDEN, dtype=np.float32)
        p["Wa"], p["ca"] = drawn(2 * HIDDEN, ATTENTION), np.zeros(ATTENTION, dtype=np.float32)
        p["va"], p["wo"] = drawn(ATTENTION, 1)[:, 0], drawn(2 * HIDDEN, 1)[:, 0]
        p["co"] = np.zeros(1, dtype=np.float32)
        return cls(vocabulary, p)

    def inputs(self, ids: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The input vector of each word."""
        starts = np.cumsum(counts) - counts
        chars = np.add.reduceat(self.p["char"][slots], starts) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1)

    def projected(self, x: np.ndarray) -> list[np.ndarray]:
        """What each word adds to the gates, for both directions."""
        return [x @ self.p["W" + side] + self.p["c" + side] for side in "fb"]

    def logits(self, gates: list[np.ndarray], rows: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit a window: ``rows`` [window, place] are rows of ``gates``, ``mask`` its words."""
        size, length = rows.shape
        states = np.empty((length, size, 2 * HIDDEN), dtype=np.float32)
        for d, side in enumerate("fb"):
            u, h = self.p["U" + side], np.zeros((size, HIDDEN), dtype=np.float32)
            order = range(length) if side == "f" else range(length - 1, -1, -1)
            for t in order:
                x, m, hu = gates[d][rows[:, t]], mask[:, t, None], h @ u
                zr = _sigmoid(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
                new = n + z * (h - n)
                if keep is not None:
                    keep[side, t] = (h, z, r, n, hu[:, 2 * HIDDEN:])
                h = np.where(m, new, h)
                states[t, :, d * HIDDEN:(d + 1) * HIDDEN] = h
        a = np.tanh(states @ self.p["Wa"] + self.p["ca"])
        e = np.where(mask.T, a @ self.p["va"], np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep["top"] = (states, a, alpha, pooled)
        return pooled @ self.p["wo"] + self.p["co"][0]

    def sliding(self, gates: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """The logit of the window at each word of ``rows`` (rows of ``gates``) that has a whole one.

        What :meth:`logits` gives window by window: neighbours read the same gates, shifted by a
        word, so that a step of all windows is arithmetic on slices.
        """
        n, p = len(rows) - WINDOW + 1, self.p
        forth, back = (np.ascontiguousarray(g[rows].T) for g in gates)
        for g in (forth, back):
            g[:2 * HIDDEN] *= np.float32(0.5)
        # tanh gives both gates: a sigmoid is half a tanh of half its input, plus a half
        half = np.repeat(np.array([0.5, 0.5, 1.0], dtype=np.float32), HIDDEN)[:, None]
        states = np.empty((WINDOW, HIDDEN, n), dtype=np.float32)

        def step(x: np.ndarray, u: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
            hu = u @ h
            zr = x[:2 * HIDDEN] + hu[:2 * HIDDEN]
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            new = zr[HIDDEN:]
            new *= hu[2 * HIDDEN:]
            new += x[2 * HIDDEN:]
            np.tanh(new, out=new)
            np.subtract(h, new, out=out)
            out *= zr[:HIDDEN]
            out += new

        h, u = np.zeros((HIDDEN, n), dtype=np.float32), np.ascontiguousarray(p["Uf"].T) * half
        for t in range(WINDOW):
            step(forth[:, t:t + n], u, h, states[t])
            h = states[t]
        h, u = np.zeros((HIDDEN, n), dtype=np.float32), np.ascontiguousarray(p["Ub"].T) * half
        own, other = np.ascontiguousarray(p["Wa"][:HIDDEN].T), np.ascontiguousarray(p["Wa"][HIDDEN:].T)
        told, weight = np.empty((WINDOW, n), dtype=np.float32), np.empty((WINDOW, n), dtype=np.float32)
        for t in range(WINDOW - 1, -1, -1):
            now = np.empty_like(h)
            step(back[:, t:t + n], u, h, now)
            h = now
            a = own @ states[t]
            a += other @ h
            a += p["ca"][:, None]
            weight[t] = p["va"] @ np.tanh(a, out=a)
            told[t] = p["wo"][:HIDDEN] @ states[t] + p["wo"][HIDDEN:] @ h
        weight -= weight.max(axis=0)
        np.exp(weight, out=weight)
        return (weight * told).sum(axis=0) / weight.sum(axis=0) + p["co"][0]

    def all_logits(self, gates: list[np.ndarray], rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The logit of every window, in the order of :func:`windows`, of texts of ``counts`` words end to end."""
        of, begin = windows(counts)
        first = np.cumsum(counts) - counts
        at, out = first[of] + begin, np.empty(len(of), dtype=np.float32)
        short = np.flatnonzero(counts[of] < WINDOW)
        for b in range(0, len(short), AT_ONCE):
            some = short[b:b + AT_ONCE]
            mask = np.arange(WINDOW) < counts[of[some], None]
            out[some] = self.logits(gates, rows[at[some, None] + np.where(mask, np.arange(WINDOW), 0)], mask)
        whole = np.flatnonzero(counts[of] >= WINDOW)
        ends = np.searchsorted(at[whole], np.arange(0, len(rows) + AT_ONCE, AT_ONCE))
        for k, b in enumerate(range(0, len(rows), AT_ONCE)):
            some = whole[ends[k]:ends[k + 1]]
            if len(some):
                low, high = at[some[0]], at[some[-1]] + WINDOW  # windows across two texts are left aside
                out[some] = self.sliding(gates, rows[low:high])[at[some] - low]
        return out

    def gradients(self, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted log loss by parameter, and by the input vectors ``x``."""
        keep: dict = {}
        logits = self.logits(self.projected(x), rows, mask, keep)
        p, g = self.p, {}
        states, a, alpha, pooled = keep["top"]
        d_logit = ((_sigmoid(logits) - labels) * weights / weights.sum()).astype(np.float32)
        g["wo"], g["co"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["wo"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = (states * d_pooled).sum(axis=2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["va"] = np.einsum("tb,tba->a", d_e, a)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["Wa"], g["ca"] = np.einsum("tbh,tba->ha", states, d_a), d_a.sum(axis=(0, 1))
        d_states = d_states + d_a @ p["Wa"].T
        d_x = np.zeros_like(x)
        for d, side in enumerate("fb"):
            u, d_h = p["U" + side], np.zeros((len(rows), HIDDEN), dtype=np.float32)
            g_u, d_gates = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
            length = rows.shape[1]
            for t in (range(length - 1, -1, -1) if side == "f" else range(length)):
                h, z, r, n, un = keep[side, t]
                d_h = d_h + d_states[t, :, d * HIDDEN:(d + 1) * HIDDEN]
                m = mask[:, t, None]
                d_new = np.where(m, d_h, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(d_gates, rows[:, t], d_in)
                g_u += h.T @ d_u
                d_h = np.where(m, 0, d_h) + d_new * z + d_u @ u.T
            g["U" + side], g["W" + side], g["c" + side] = g_u, x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ p["W" + side].T
        return g, d_x


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k, grad in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * grad
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * grad * grad
            scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            p[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def train(texts: list[list[str]], labels: np.ndarray, base: float, seed: int = 4, epochs: tuple[int, int] = (WARM, EPOCHS)) -> Network:
    """A network from texts as lists of words; ``base`` is the share of toxic texts where it will be used."""
    labels = np.asarray(labels, dtype=np.float32)
    seen = Counter(w for t in texts for w in set(t))
    common = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network.fresh({w: i + 1 for i, w in enumerate(common)}, seed)
    net.base = base
    usable = [i for i, t in enumerate(texts) if t]
    if not usable or len(set(labels[usable].tolist())) < 2:
        net.p["wo"][:] = 0
        net.p["co"][:] = np.log(base / (1 - base)) if 0 < base < 1 else (20 if base else -20)
        return net
    texts, labels = [texts[i] for i in usable], labels[usable]
    rng, adam = np.random.default_rng(seed), _Adam(RATE)
    names = sorted(seen)
    at = {w: i for i, w in enumerate(names)}
    ids = np.array([net.vocabulary.get(w, 0) for w in names])
    slots, sizes = trigram_slots(names)
    slot_starts = np.cumsum(sizes) - sizes
    flat = np.array([at[w] for t in texts for w in t])
    counts = np.array([len(t) for t in texts])
    first = np.cumsum(counts) - counts
    of, begin = windows(counts)
    firsts = np.searchsorted(of, np.arange(len(texts)))
    numbers = np.bincount(of, minlength=len(texts))

    def cut(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = begin[chosen, None] + np.arange(WINDOW)
        mask = place < counts[of[chosen], None]
        return flat[first[of[chosen], None] + np.where(mask, place, 0)], mask

    def scored() -> np.ndarray:
        return net.all_logits(net.projected(net.inputs(ids, slots, sizes)), flat, counts)

    weight = np.where(labels == 1, base / max(labels.mean(), 1e-9), (1 - base) / max(1 - labels.mean(), 1e-9)).astype(np.float32)
    weight = np.sqrt(weight)  # between even classes and the true share
    for epoch in range(sum(epochs)):
        pick = firsts + rng.integers(0, numbers)
        if epoch >= epochs[0]:
            if (epoch - epochs[0]) % AGAIN == 0:
                highest = np.lexsort((-scored(), of))[firsts]
            pick = highest
        again = np.arange(len(texts))
        if epoch >= epochs[0]:  # clean texts also show a window at random
            extra = np.flatnonzero(labels == 0)
            pick = np.concatenate([pick, firsts[extra] + rng.integers(0, numbers[extra])])
            again = np.concatenate([again, extra])
        shuffled = rng.permutation(len(pick))
        for b in range(0, len(pick), BATCH):
            part = shuffled[b:b + BATCH]
            words, mask = cut(pick[part])
            distinct, rows = np.unique(words, return_inverse=True)
            n = sizes[distinct]
            local = slots[np.repeat(slot_starts[distinct] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            shown = np.where(rng.random(len(distinct)) < UNKNOWN, 0, ids[distinct])
            x = net.inputs(shown, local, n)
            g, d_x = net.gradients(x, rows.reshape(words.shape), mask, labels[again[part]], weight[again[part]])
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], shown, d_x[:, :WORD])
            np.add.at(g["char"], local, np.repeat(d_x[:, WORD:] / n[:, None], n, axis=0))
            adam.step(net.p, g)
    return net


def clean_words(text: str | Column) -> Column:
    """Runs of letters, digits and marks in lower case, one space apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: the crc32 of its id as text is a multiple of 5."""
    return F.coalesce(fold(id_col, 5) == 0, F.lit(False))


def fit(
    df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
    toxic: int = TOXIC, clean: int = CLEAN,
) -> Network:
    """A network from at most ``toxic`` and ``clean`` labelled texts, the first by a hash of their ids.

    Texts of over ``CHARS`` characters are not learned from. The share of toxic texts counts all
    labelled rows. Without labels of both kinds the network gives that share (0.5 without any).
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null and id is not null")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    base = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    short = marked.join(rows.where(F.length("text") <= CHARS).select("id").distinct(), "id")
    chosen = sample_ids(short.where("toxic = 1"), "id", "toxic", toxic).union(sample_ids(short.where("toxic = 0"), "id", "toxic", clean))
    # of bounded size: toxic + clean ids
    chosen = F.broadcast(chosen.select(F.col("_id").alias("id"), F.col("_class").alias("toxic")))
    short_rows = rows.where(F.length("text") <= CHARS).join(chosen, "id").select("id", clean_words("text").alias("text"), "toxic")
    got = short_rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()  # a text for each id
    got.sort(key=lambda r: (r.id, r.text or ""))
    return train([(r.text or "").split() for r in got], np.array([r.toxic for r in got]), base)


def score(df: DataFrame, network: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score): the highest window of every whole text, between 0 and 1.

    A text without words, null and empty ones too, scores the share of toxic texts. Repeated
    rows and null ids give a row each; equal texts score alike. Extra columns are not read.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(clean_words(F.col(text_col).cast("string")), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    shared = Sent(df.sparkSession, network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        at_word: dict[str, int] = {}
        tables = [np.zeros((0, 3 * HIDDEN), dtype=np.float32)] * 2
        for batch in sliced(batches, "text", 1 << 20):
            parts = pa.compute.split_pattern(batch.column("text").cast(pa.large_string()), " ")
            counts = pa.compute.list_value_length(parts).to_numpy().astype(np.int64)
            coded = parts.flatten().dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            empty = pa.compute.equal(batch.column("text"), "").to_numpy(zero_copy_only=False)
            if len(at_word) > REMEMBERED:
                at_word.clear()
                tables = [t[:0] for t in tables]
            new = [w for w in names if w not in at_word]
            if new:
                slots, sizes = trigram_slots([w or " " for w in new])
                ids = np.fromiter((net.vocabulary.get(w, 0) for w in new), dtype=np.int64, count=len(new))
                at_word.update(zip(new, range(len(at_word), len(at_word) + len(new)), strict=True))
                tables = [np.concatenate(x) for x in zip(tables, net.projected(net.inputs(ids, slots, sizes)), strict=True)]
            rows = np.fromiter((at_word[w] for w in names), dtype=np.int64, count=len(names))[codes]
            of, _ = windows(counts)
            logits = net.all_logits(tables, rows, counts)
            best = np.maximum.reduceat(logits, np.searchsorted(of, np.arange(len(counts)))) if len(of) else logits
            value = np.where(empty, net.base, _sigmoid(best.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value)], names=["id", "score"])

    return docs.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def detect(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from labels not held out."""
    network = fit(df, labels.where(~held_out()))
    return score(df, network).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
