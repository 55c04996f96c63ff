"""Learned operators: the mathematics by brute force, accuracy on rows held out, and odd rows."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kwloom.llm import base, toxicity
from kwloom.llm import language_id as li

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return li.fit(documents.where(~li.held_out()), PIECES, per_language=60)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    table = li.Pieces.build(pieces)
    p = np.random.default_rng(0).random((len(pieces) + 2, 2))
    p[-2:] = [[0.0, 0.0], [li.UNKNOWN] * 2]
    for word in ("▁abab", "▁ba", "▁abcab"):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            parts.append(word[last:])
            rows = [pieces.index(x) if x in pieces else (-1 if len(x) == 1 else -2) for x in parts]
            want += np.prod([p[r] for r in rows], axis=0)
        letters = li._letters([word], len(word))
        assert np.allclose(li.forward(table.lattice(letters), p)[len(word), 0], want)


def test_runs_of_any_length_are_summed_alike(monkeypatch):
    pieces = li.read_pieces(PIECES)
    assert max(map(len, pieces)) == 16 and len(pieces) > 25_000
    table = li.Pieces.build(pieces)
    p = np.random.default_rng(0).random((len(pieces) + 2, 2)) * 1e-3
    p[-2:] = [[0.0, 0.0], [li.UNKNOWN] * 2]
    lattice = table.lattice(li._letters([(li.START + "internationalisationthequick" * 2)[:40], (li.START + "ß水" + "abcd" * 10)[:40]], 40))
    for plain, back in ((li.forward, False), (li.backward, True)):
        values, scale = li.scaled(lattice, p, back)
        assert np.allclose(np.log(values) + scale, np.log(plain(lattice, p)), rtol=1e-12)
    counts = {"a": {"thequickbrown": 3, "fox": 1, "jumps" * 5: 2}, "b": {"zwölf": 2, "boxkämpfer": 1}}
    usual = li.learn(counts, pieces, {"a": 1, "b": 1})
    monkeypatch.setattr(li, "SHORT", 0)  # all words by the scaled sums
    other = li.learn(counts, pieces, {"a": 1, "b": 1})
    assert np.allclose(usual.probabilities, other.probabilities, rtol=1e-9)
    assert np.allclose(usual.scores(["thequick"]), other.scores(["thequick"]))


def test_expected_counts_are_those_of_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "▁", "▁a"]
    table = li.Pieces.build(pieces)
    p = np.random.default_rng(1).random((len(pieces) + 2, 1))
    p[-2:] = [[0.0], [li.UNKNOWN]]
    word, total, want = "▁abab", 0.0, np.zeros(len(pieces) + 2)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts = "".join(c + "|" * k for c, k in zip(word, [*cuts, 0], strict=True)).split("|")
        rows = [pieces.index(x) if x in pieces else -2 for x in parts]
        chance = np.prod([p[r, 0] for r in rows])
        total += chance
        np.add.at(want, rows, chance)
    lattice = table.lattice(li._letters([word], len(word)))
    alpha, beta, got = li.forward(lattice, p)[:, :, 0], li.backward(lattice, p)[:, :, 0], np.zeros(len(pieces) + 2)
    li._expect(got, lattice, p, alpha, beta / alpha[len(word)])
    assert np.allclose(got, want / total)


def test_text_without_spaces(spark):
    rng = random.Random(2)
    syllables = {"a": ["ka", "mi", "to", "shi", "ne"], "b": ["blo", "gra", "dun", "vek", "ost"]}
    rows = [(i, "".join(rng.choice(syllables[x]) for _ in range(400)), x) for i, x in enumerate("ab" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs.where("doc_id < 20"), PIECES)
    got = li.predict(docs, model).join(docs, "doc_id").collect()
    assert len(got) == 40 and all(r.lang_pred == r.lang and r.score > 0.99 for r in got)


def test_language_on_held_out_rows(documents, model):
    got = documents.select("doc_id", "lang", li.held_out().alias("out")).join(li.predict(documents, model), "doc_id").where("out")
    right, total = got.where("lang = lang_pred").count(), got.count()
    assert right >= 0.97 * total


def test_language_of_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !"), (None, "the and of the"), (4, "x" * 100), (5, "the " * 30000), (5, "the " * 30000)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, score string")
    got = li.predict(df, model).toDF("doc_id", "lang_pred", "value").collect()
    assert len(got) == 7 and all(0 <= r.value <= 1 for r in got)
    told = {r.doc_id: r.lang_pred for r in got}
    assert told[1] == told[2] == told[3] == "und" and told[None] == told[5] == "en"
    nothing = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert li.fit(nothing, PIECES) is None
    assert {r.lang_pred for r in li.predict(df, None).collect()} == {"und"}
    assert li.predict(df.limit(0), model).count() == 0


def test_sample_is_bounded_and_whole_for_small_classes(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 7, "rare").otherwise("common").alias("kind"))
    sizes = {r._class: r["count"] for r in base.sample_ids(df, "id", "kind", 50).groupBy("_class").count().collect()}
    assert sizes == {"rare": 7, "common": 50}


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh({"a": 1, "b": 2})
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, rows = rng.standard_normal((7, toxicity.WORD + toxicity.CHAR)), rng.integers(0, 7, (3, 5))
    mask = np.arange(5) < np.array([[5], [2], [4]])
    labels = np.array([1.0, 0.0, 1.0])
    g, d_x = net.gradients(x, rows, mask, labels, np.ones(3))

    def loss():
        logits = net.logits(net.projected(x), rows, mask).astype(float)
        return float((np.logaddexp(0, logits) - labels * logits).mean())

    for name, values, grad in [*((k, net.p[k], g[k]) for k in ("wo", "Wa", "va", "Uf", "Ub", "Wf", "Wb", "cf", "co")), ("x", x, d_x)]:
        at = tuple(rng.integers(0, s) for s in values.shape)
        old, step = values[at], 1e-2
        values[at] = old + step
        up = loss()
        values[at] = old - step
        down = loss()
        values[at] = old
        assert abs((up - down) / (2 * step) - grad[at]) < 2e-4, name


def test_windows_start_at_every_word():
    sizes = [0, 1, 5, 6, 7, 40]
    of, begin = toxicity.windows(np.array(sizes))
    for text, n in enumerate(sizes):
        assert begin[of == text].tolist() == list(range(max(n - toxicity.WINDOW, 0) + 1 if n else 0))


def test_all_windows_score_as_one_by_one(monkeypatch):
    monkeypatch.setattr(toxicity, "AT_ONCE", 16)
    rng = np.random.default_rng(3)
    net = toxicity.Network.fresh({f"w{k}": k + 1 for k in range(30)}, seed=9)
    for name in net.p:  # far from the start, so that gates close and open
        net.p[name] = (net.p[name] + rng.normal(size=net.p[name].shape) * 0.5).astype(np.float32)
    names = [f"w{k}" for k in range(40)]
    slots, sizes = toxicity.trigram_slots(names)
    gates = net.projected(net.inputs(np.arange(1, 41) % 31, slots, sizes))
    counts = np.array([3, 0, 50, 6, 1, 5, 7, 0, 33])
    rows = rng.integers(0, 40, counts.sum())
    got = net.all_logits(gates, rows, counts)
    of, begin = toxicity.windows(counts)
    first = np.cumsum(counts) - counts
    for k, (text, start) in enumerate(zip(of, begin, strict=True)):
        size = min(toxicity.WINDOW, counts[text])
        at = first[text] + start
        one = net.logits(gates, rows[None, at:at + size], np.ones((1, size), dtype=bool))
        assert abs(float(one[0]) - float(got[k])) < 1e-4
    assert len(got) == len(of) == 1 + 45 + 1 + 1 + 1 + 2 + 28


def test_toxicity_learns_words_and_scores_odd_rows(spark):
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(300):
        words = [f"w{k}" for k in rng.integers(0, 200, rng.integers(5, 120))]
        if i % 3 == 0:
            words[int(rng.integers(0, len(words)))] = ["vile", "nasty"][i % 2]
        texts.append(words)
        labels.append(int(i % 3 == 0))
    net = toxicity.train(texts, np.array(labels), 1 / 3)
    rows = [(1, None), (2, ""), (3, "..."), (4, "w1 w2 " * 2000 + "vile"), (5, "w1 w2 " * 2000), (None, "w3"), (5, "w1 w2 " * 2000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = [(r.doc_id, r.score) for r in toxicity.score(df, net).collect()]
    score = dict(got)
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    assert score[4] > 0.5 > score[5] and score[1] == score[2] == score[3] == net.base
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.detect(df, no_labels).select("predicted").collect()} <= {0, 1}
    assert toxicity.score(df.limit(0), net).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Each stage keeps the columns, takes its decision and keeps clean documents."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = [(900, None), (901, "123 456"), (902, f"before {item} after"), (None, "the and of the in that and to")]
    added = spark.createDataFrame([(i, t, "en", "src", 1) for i, t in odd], docs.schema)
    docs = base.stored(docs.union(added))
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = base.stored(stage(spark, docs, sf))
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = out
    assert ids[0] == {r.doc_id for r in added.sparkSession.read.parquet(f"{sf}/documents.parquet").collect()} | {902, None}
    assert 902 in ids[2] and 902 not in ids[3] and None in ids[4] and ids[3] == ids[4]
    assert len(ids[1]) < len(ids[0]) and len(ids[3]) > 0.8 * len(ids[0])


def test_pipeline_stages_on_other_odd_tables(spark):
    """Clashing columns, nulls everywhere, repeated rows, long texts and empty tables, stage by stage."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    names = ["id", "row", "said", "n_words", "kept", "packed", "place", "_column_0", "score", "digest"]
    wide = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in wide.dtypes)  # all may be null
    long = " ".join(f"the word of that number {i}" for i in range(30_000))
    first = wide.first()
    extra = [
        {**first.asDict(), "doc_id": 7000, "text": long}, {**first.asDict(), "doc_id": 7001, "text": long.upper()},
        {**first.asDict(), "doc_id": 7002, "text": "the one and the other of them"}, {**first.asDict(), "doc_id": 7002, "text": "the one and the other of them"},
        dict.fromkeys(wide.columns),
    ]
    wide = base.stored(wide.union(spark.createDataFrame([tuple(r[c] for c in wide.columns) for r in extra], kinds)))
    now = wide
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), sf).count() == 0
        out = base.stored(stage(spark, now, sf))
        if name == "byte_bpe":
            assert out.count() == now.count()
            continue
        assert out.columns == wide.columns and out.where("doc_id is not null and said <> 'own said'").count() == 0
        rows = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "language_id":
            assert rows.count(7002) == 2 and 7000 in rows and None not in rows
        else:
            assert rows.count(7002) == 2 and 7001 not in rows and 7000 in rows
        now = out
