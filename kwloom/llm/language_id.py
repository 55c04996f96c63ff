"""Language by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary, learned by expectation
maximisation. The probability of a word is the sum over all its segmentations into pieces, which
a forward algorithm takes without listing them; words are independent, so is the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwloom.llm.base import Sent, fold, sample_ids, sliced, trim_memory
from kwloom.llm.hashing import mixed, powers

#: Documents of a language that are learned from, and its most frequent words among them.
PER_LANGUAGE, WORDS = 400, 60_000
#: Letters of a run up to which probabilities fit a float; longer ones are scaled as they go,
#: every so many letters.
SHORT, SCALED = 40, 16
ROUNDS = 4
#: What each piece is counted before any text is seen, and the probability of an unknown letter.
PRIOR, UNKNOWN = 0.01, 1e-6
#: Words whose scores a task remembers; when full, it starts anew.
REMEMBERED = 150_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
START = "▁"


def read_pieces(model_path: str) -> list[str]:
    """The pieces of a sentencepiece model, in lower case, without byte and control pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    )
    return sorted({p.lower() for p in pieces})


def _letters(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size)


@dataclass
class Pieces:
    """A hash table from the letters of a piece to its number."""

    keys: np.ndarray
    values: np.ndarray
    count: int
    longest: int

    @classmethod
    def build(cls, pieces: list[str]) -> Pieces:
        slots = 1 << max(4, (8 * len(pieces)).bit_length())
        keys, values = np.zeros(slots, dtype=np.uint64), np.full(slots, len(pieces), dtype=np.int32)
        for size in sorted({len(p) for p in pieces}):
            of = [i for i, p in enumerate(pieces) if len(p) == size]
            hashes = cls.hashes(_letters([pieces[i] for i in of], size), 0, size)
            for i, h in zip(of, hashes, strict=True):
                at = int(h) & (slots - 1)
                while keys[at]:
                    at = (at + 1) & (slots - 1)
                keys[at], values[at] = h, i
        return cls(keys, values, len(pieces), max(map(len, pieces), default=1))

    @staticmethod
    def hashes(letters: np.ndarray, start: int, size: int) -> np.ndarray:
        part = letters[:, start:start + size].astype(np.uint64)
        return mixed((mixed(part) * powers(_BASE, size)).sum(axis=1, dtype=np.uint64)) | np.uint64(1)

    def lattice(self, letters: np.ndarray) -> np.ndarray:
        """[word, start, length - 1]: the piece there; ``count`` for none, + 1 for an unknown letter."""
        n, size = letters.shape
        out = np.full((n, size, min(self.longest, size)), self.count, dtype=np.int32)
        total = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum(mixed(letters.astype(np.uint64)) * powers(_BASE, size)[None, :], axis=1, out=total[:, 1:])
        back = powers(_BACK, size)
        mask = np.uint64(len(self.keys) - 1)
        for length in range(1, min(self.longest, size) + 1):
            h = mixed((total[:, length:] - total[:, :-length]) * back[None, :size - length + 1]) | np.uint64(1)
            at = (h & mask).astype(np.int64)
            there = self.keys[at]
            found = np.where(there == h, self.values[at], np.int32(self.count))
            open_ = np.nonzero((there != h) & (there != 0))
            h, at = h[open_], at[open_]
            while len(h):
                at = (at + 1) & int(mask)
                there = self.keys[at]
                hit = there == h
                found[open_[0][hit], open_[1][hit]] = self.values[at[hit]]
                go = ~hit & (there != 0)
                open_, h, at = tuple(x[go] for x in open_), h[go], at[go]
            out[:, :size - length + 1, length - 1] = found
        single = out[:, :, 0]
        single[single == self.count] = self.count + 1
        return out


def forward(lattice: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """[position, word, language]: the summed probability of all segmentations up to there."""
    n, size, longest = lattice.shape
    alpha = np.zeros((size + 1, n, probabilities.shape[1]))
    alpha[0] = 1.0
    for end in range(1, size + 1):
        for length in range(1, min(longest, end) + 1):
            alpha[end] += alpha[end - length] * probabilities[lattice[:, end - length, length - 1]]
    return alpha


def backward(lattice: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """[position, word, language]: the summed probability of all segmentations from there on."""
    n, size, longest = lattice.shape
    beta = np.zeros((size + 1, n, probabilities.shape[1]))
    beta[size] = 1.0
    for start in range(size - 1, -1, -1):
        for length in range(1, min(longest, size - start) + 1):
            beta[start] += beta[start + length] * probabilities[lattice[:, start, length - 1]]
    return beta


def _expect(expected: np.ndarray, lattice: np.ndarray, p: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
    """Add how often each piece is used: at every place, by all segmentations that use it there."""
    _, size, longest = lattice.shape
    for start in range(size):
        for length in range(1, min(longest, size - start) + 1):
            of = lattice[:, start, length - 1]
            np.add.at(expected, of, alpha[start] * p[of, 0] * beta[start + length])


def scaled(lattice: np.ndarray, probabilities: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """([position, word, language], logarithms of its scale): :func:`forward` for runs of any length.

    ``back`` sums the segmentations from each position to the end instead.
    """
    n, size, longest = lattice.shape
    out = np.zeros((size + 1, n, probabilities.shape[1]))
    scale, now = np.zeros_like(out), np.zeros(out.shape[1:])
    ring = np.zeros((longest + 1, *out.shape[1:]))  # this position and the next ones, on one scale
    ring[0] = 1.0
    for step in range(size + 1):
        at = size - step if back else step
        if back and step:
            reach = min(longest, step)
            steps = probabilities[lattice[:, at, :reach]]  # [word, length, language]
            ring[0] = np.einsum("nkl,knl->nl", steps, ring[1:reach + 1])
        out[at], scale[at] = ring[0], now
        if not back and step < size:
            reach = min(longest, size - step)
            ring[1:reach + 1] += np.moveaxis(probabilities[lattice[:, at, :reach]], 1, 0) * ring[0]
        if step % SCALED == SCALED - 1:
            most = np.where(ring.max(axis=0) > 0, ring.max(axis=0), 1.0)
            ring, now = ring / most, now + np.log(most)
        ring = np.roll(ring, 1 if back else -1, axis=0)
        ring[0 if back else -1] = 0.0
    return out, scale


def _by_length(words: list[str], rows: int = 8_000) -> Iterator[np.ndarray]:
    """Indices of words of one length, at most ``rows`` at a time, and fewer of long ones."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        most = max(1, min(rows, rows * SHORT // max(len(words[part[0]]), 1))) if len(part) else 1
        for begin in range(0, len(part), most):
            yield part[begin:begin + most]


@dataclass
class Model:
    """Piece probabilities of each language, with rows for no piece and for an unknown letter."""

    pieces: Pieces
    languages: list[str]
    probabilities: np.ndarray
    prior: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: log probability of each word."""
        words = [START + w for w in words]
        out = np.empty((len(words), len(self.languages)))
        for part in _by_length(words):
            size = len(words[part[0]])
            lattice = self.pieces.lattice(_letters([words[i] for i in part], size))
            if size <= SHORT:
                out[part] = np.log(forward(lattice, self.probabilities)[size])
            else:
                alpha, scale = scaled(lattice, self.probabilities)
                out[part] = np.log(alpha[size]) + scale[size]
        return out


def learn(counts: dict[str, dict[str, int]], pieces: list[str], prior: dict[str, int]) -> Model:
    """Piece probabilities from the word counts of each language, by expectation maximisation."""
    table = Pieces.build(pieces)
    languages = sorted(counts)
    columns = []
    for language in languages:
        words = [START + w for w in counts[language]]
        weights = np.fromiter(counts[language].values(), dtype=float, count=len(words))
        p = np.full((table.count + 2, 1), 1.0 / table.count)
        p[-2:, 0] = 0.0, UNKNOWN
        for _ in range(ROUNDS):
            expected = np.full(table.count + 2, PRIOR)
            for part in _by_length(words):
                size = len(words[part[0]])
                lattice = table.lattice(_letters([words[i] for i in part], size))
                if size <= SHORT:
                    alpha, beta = forward(lattice, p), backward(lattice, p)
                    _expect(expected, lattice, p, alpha[:, :, 0], beta[:, :, 0] * (weights[part] / alpha[size, :, 0]))
                    continue
                (alpha, up), (beta, down) = scaled(lattice, p), scaled(lattice, p, back=True)
                whole = np.log(alpha[size]) + up[size]
                # what both sums are short of is put on the second, place by place
                longest = lattice.shape[2]
                for start in range(size):
                    ends = slice(start + 1, start + 1 + min(longest, size - start))
                    away = np.exp(up[start, :, 0] + down[ends, :, 0] - whole[:, 0])
                    of = lattice[:, start, :ends.stop - ends.start]
                    step = p[of, 0] * (beta[ends, :, 0] * away).T
                    np.add.at(expected, of, step * (alpha[start, :, 0] * weights[part])[:, None])
            expected[-2:] = 0.0
            p[:, 0] = expected / expected.sum()
            p[-2:, 0] = 0.0, UNKNOWN
        columns.append(p[:, 0])
    total = np.array([prior[x] for x in languages], dtype=float)
    return Model(table, languages, np.stack(columns, axis=1), np.log(total / total.sum()))


def _letter_words(text: str | Column) -> Column:
    """Runs of letters in lower case, one space apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def fit(
    df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, words: int = WORDS,
) -> Model | None:
    """A model from a sample of labelled rows; None if no row has both a label and a letter.

    At most ``per_language`` documents of a language (by a hash of their ids) and ``words`` of
    its most frequent words come to the driver; how common each language is counts all rows.
    """
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    prior = {r.lang: r["count"] for r in labelled.where("lang is not null").groupBy("lang").count().collect()}
    # of bounded size: per_language rows for each language
    chosen = F.broadcast(sample_ids(labelled, "id", "lang", per_language).select(F.col("_id").alias("id")).distinct())
    parts = F.split(_letter_words("text"), " ")
    counted = (
        labelled.where("lang is not null").join(chosen, "id").select("lang", F.explode(parts).alias("word"))
        .where(F.col("word") != "").groupBy("lang", "word").count()
    )
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    counts: dict[str, dict[str, int]] = {}
    for r in counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= words).collect():
        counts.setdefault(r.lang, {})[r.word] = r["count"]
    return learn(counts, read_pieces(model_path), prior) if counts else None


def told(text: str | Column, model: Model | None, spark: SparkSession) -> Column:
    """(lang_pred, score) of a text: what :func:`predict` says. Only the text's letters go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    shared = Sent(spark, model)

    @F.arrow_udf("lang_pred string, score double")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, at_word = shared.value, {}
        table = np.zeros((0, len(model.languages) if model else 0))
        for array in texts:
            whole = pa.RecordBatch.from_arrays([array], names=["text"])
            done: list[pa.Array] = []
            for batch in sliced([whole], "text", 1 << 20):
                known = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
                if model is None:
                    known = np.zeros(len(known), dtype=bool)
                best, score = np.zeros(len(known), dtype=np.int64), np.zeros(len(known))
                if known.any():
                    parts = pa.compute.split_pattern(batch.column("text").filter(pa.array(known)).cast(pa.large_string()), " ")
                    sizes = pa.compute.list_value_length(parts).to_numpy().astype(np.int64)
                    coded = parts.flatten().dictionary_encode()
                    distinct = coded.dictionary.to_pylist()
                    if len(at_word) > REMEMBERED:
                        at_word, table = {}, table[:0]
                    new = [w for w in distinct if w not in at_word]
                    if new:
                        at_word.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                        table = np.concatenate([table, model.scores(new)])
                    rows = np.fromiter((at_word[w] for w in distinct), dtype=np.int64, count=len(distinct))
                    each = table[rows[coded.indices.to_numpy()]]
                    total = np.add.reduceat(each, np.cumsum(sizes) - sizes) + model.prior
                    top = total.argmax(axis=1)
                    odds = np.exp(total - total[np.arange(len(top)), top][:, None]).sum(axis=1)
                    best[known], score[known] = top, 1.0 / odds
                names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                done.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], names=["lang_pred", "score"]))
            yield pa.concat_arrays(done) if done else pa.StructArray.from_arrays(
                [pa.array([], pa.string()), pa.array([], pa.float64())], names=["lang_pred", "score"])
        at_word.clear()
        trim_memory()

    letters = F.when(text.rlike(r"\p{L}"), _letter_words(text))
    return judged.asNondeterministic()(letters)  # else it runs again for a filter on what it says


def predict(df: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text and its probability.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text when
    there is no model. Ties go to the language first in order. Repeated rows and null ids give
    a row each; an empty table gives none. Other columns are not read.
    """
    said = told(F.col(text_col).cast("string"), model, df.sparkSession)
    return df.select(F.col(id_col), said.alias("_told")).select(id_col, "_told.lang_pred", "_told.score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: the crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(fold(id_col, 3) == 1, F.lit(False))


def identify(df: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the labelled rows that are not held out."""
    model = fit(df.where(~held_out()), model_path)
    return predict(df, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
