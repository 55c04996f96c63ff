"""Operators with exact results, held against brute force on the given tables and on odd rows."""

import base64
import hashlib
import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from kwloom.llm import bpe, decontaminate, html_text, license_scan, substring_dedup, url_filter, vp_tree
from kwloom.llm import order_minhash as om
from kwloom.llm.components import components
from kwloom.llm.queries import ORACLES, QUERIES, RANKS

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [
    (100, None), (101, ""), (102, "   "), (None, "a null id"), (103, "short"), (104, " ".join(["x"] * 60)),
    (105, "\n".join(["x"] * 45) + "\ty z"), (106, "word " * 3000), (107, "word " * 3000), (107, "word " * 3000),
    (108, "it's  we'll\n\n don't stop ＃ é x "), (109, "!" * 40 + " " * 7), (110, "tail \n"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n long")


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.execute(ORACLES[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    got, want = (x[order].sort_values(order).reset_index(drop=True).convert_dtypes() for x in (got, want))
    assert got.equals(want)


# URL filter


def test_url_rules_of_every_kind(spark):
    rows = [
        (1, None), (2, ""), (3, "no/scheme"), (4, "HTTP://A.NET"), (5, "http://x.EXAMPLE.net/en/x?://y"),
        (6, "http://example.com/de"), (7, "http://example.com/de/"), (8, "http://a.org/fr/q\nz?x"), (9, "http://ads.foo.de/"),
        (10, "http://x/a?utm_source=feed"), (11, "http://x/a?utm_source=feedx"), (12, "http://ads.t.com/robots.txt"), (12, "://"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {
        (1, ""): ("", None, "allow"), (2, ""): ("", None, "allow"), (3, ""): ("", None, "allow"),
        (4, "a.net"): ("", None, "allow"), (5, "x.example.net"): ("/en/x", "example.net/en/", "allow"),
        (6, "example.com"): ("/de", None, "allow"), (7, "example.com"): ("/de/", "example.com/de/", "block"),
        (8, "a.org"): ("/fr/q\nz", "org/fr/", "allow"), (9, "ads.foo.de"): ("/", None, "block"),
        (10, "x"): ("/a", None, "allow"), (11, "x"): ("/a", None, "allow"),
        (12, "ads.t.com"): ("/robots.txt", None, "allow"), (12, ""): ("", None, "allow"),
    }
    assert url_filter.judge(empty(df)).count() == 0


def test_url_index_never_loses_a_match():
    rng = random.Random(1)
    rules = [url_filter.Rule("block", p) for p in ("/ab/*^cd^", "||xy.ab", "ab*cd", "^cd=", "|http://ab", "cd/|", "*ab*", "a^b")]
    filed, rest = url_filter.index(rules, {"ab": 5, "cd": 2})
    for _ in range(4000):
        url = "http://" + "".join(rng.choice(["ab", "cd", "xy", "/", ".", "=", "?", "a", "b"]) for _ in range(rng.randrange(8)))
        fetched = {i for t in re.findall(url_filter.TOKEN, url) for i in filed.get(t, ())} | set(rest)
        assert {i for i, r in enumerate(rules) if re.search(r.regex, url)} <= fetched


def test_url_spam_hosts_are_blocked(spark):
    """Every given page of a spam host is blocked unless a host rule says otherwise, and no other page by a pattern."""
    got = url_filter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").collect()
    spam = [r for r in got if any(x in r.host for x in ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"))]
    assert len(spam) >= 100 and all(r.verdict == "block" for r in spam)
    assert {r.page_id for r in got if r.verdict == "block"} == {r.page_id for r in spam}


def test_url_rules_from_a_table(spark):
    table = spark.createDataFrame([("block", f"/shop{i}/") for i in range(3000)] + [("allow", "/shop7/ok|")], "action string, pattern string")
    rules = url_filter.rule_table(table.union(table))
    assert len(rules) == 3001
    urls = spark.createDataFrame([(1, "http://x.y/shop2999/z"), (2, "http://x.y/shop7/ok"), (3, "http://x.y/shop7/no"), (4, "http://x.y/" + "a/" * 40000 + "shop1/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(urls, pattern_rules=rules).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block"}


def test_url_host_words():
    regexes = [re.compile(url_filter.Rule(*r).regex, re.DOTALL) for r in url_filter.host_word_rules(["bets"])]
    hit = lambda u: any(r.search(u) for r in regexes)
    assert all(map(hit, ("http://bets.com/", "https://m.bets-win.com", "http://free-bets.example.com/x", "http://www.free-bets.example.com")))
    assert not any(map(hit, ("http://alphabets.com/", "http://x.com/free-bets.html", "http://x.com/bets.", "http://abets.bet-s.com/")))


# Vantage-point trees


def brute_nearest(rows, k):
    rows = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in rows.items():
        if q % 20 == 0:
            near = sorted((-float((a * b).sum()), i) for i, b in rows.items() if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_vp_tree_exact_at_factor_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(900)]
    rows += [(i, [1.0] * 8) for i in range(900, 960)] + [(960, None), (980, [0.0] * 8), (1000, [1.0, None] * 4)]
    rows += [(1020, [float("nan")] * 8), (None, [1.0] * 8), (1040, [2.0, 1.0]), (1041, [1.0, 3.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    query = F.col("vec_id") % 20 == 0
    got = sorted(tuple(r) for r in vp_tree.nearest(df, query, factor=1.0).collect())
    assert got == brute_nearest(rows, 20)
    assert vp_tree.nearest(empty(df), query).count() == 0


def test_vp_tree_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = {(q, i) for q, _, i, _ in brute_nearest([(r.vec_id, list(r.embedding)) for r in df.collect()], 20)}
    got = {(r.query_id, r.vec_id) for r in vp_tree.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert len(got & want) >= 0.9 * len(want)


# Order MinHash


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
        best = row
    return best[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        b = b or [1]
        m, x, y = longest_common(a, b), np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        assert om.aligned(x, y, m) and not om.aligned(x, y, m + 1)


def test_near_duplicates(spark, odd):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = {0: base, 1: base, 2: base[:90] + ["new"] + base[91:], 3: base[:40] + base[50:], 4: rng.sample(base, 200), 5: base[100:] + base[:100]}
    chain = [base[k:] + [f"z{j}" for j in range(k)] for k in (15, 30)]  # each like the one before, the last unlike the first
    texts |= {6: chain[0], 7: chain[1]}
    rows = [(i, " ".join(t).upper() if i == 1 else " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id: (r.class_id, r.copy_of) for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 6, 7)] == [0] * 6
    assert got[1][1] == 0 and got[4] == (4, 4)
    assert got[5] == (5, 5)  # the same shingles in another order do not align
    found = om.near_duplicates(odd).collect()
    assert len(found) == len({i for i, _ in ODD_TEXTS})
    classes = {r.doc_id: r.class_id for r in found}
    assert classes[107] == 106 and all(classes[i] == i for i in (100, 101, 102, 103, 104, None))
    assert om.near_duplicates(empty(odd)).count() == 0


def test_large_bucket_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(base[:i % 140] + [f"own{i}"] + base[i % 140 + 1:])) for i in range(60)]
    rows += [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(150))) for i in range(60, 80)]
    got = {r.doc_id: r.class_id for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[i] == i for i in range(60, 80))


def test_links_of_a_boilerplate_group_by_brute_force(spark):
    rng = random.Random(6)
    shared = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(320):  # near copies with words of their own; every fourth shares the boilerplate only
        t = list(shared)
        for k in range(rng.randrange(1, 6)):
            t[rng.randrange(150)] = f"own{i}x{k}"
        if i % 4 == 0:
            t = t[:110] + [f"other{i}x{k}" for k in range(60)]
        if i % 7 == 0:
            t = t[75:] + t[:75]
        rows.append((i, " ".join(t)))
    parts = om.shingles(om.Words.of(pa.array([t for _, t in rows])), om.SHINGLE)
    want, label = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if om.similar(parts[a], parts[b], om.THRESHOLD):
                want[a], want[b] = want[a] + 1, want[b] + 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r.doc_id: (r.n_links, r.class_id) for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(want) > 100 and got == {i: (want[i], label[i]) for i in range(len(rows))}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (60, 60), (None, 3)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 45: 40, 50: 40}


# License scan


def test_license_scan(spark):
    grant = ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
             "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n"
             "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to "
             "whom the Software is\nfurnished to do so, subject to the following conditions:")
    rows = [
        ("LICENSE", grant), ("a/b/x.py", None), ("a/b/COPYING", "Licensed under CC BY-NC 4.0."), ("a/b/c/y.py", ""),
        ("z.py", "# Licensed under the Apache License, Version 2.0.\r\nimport x"), (None, "x"), ("a/bb/q", "the of and to"),
        ("a/bb/q", "Released under the MIT License."), ("a/c", "word " * 5000),
    ]
    rows += [(f"f/{i}", "the rights of the person to the copy and of the version") for i in range(40)]
    df = spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, license string")
    got = {r.path: (r.license, r.found, r.origin) for r in license_scan.scan(df).collect()}
    assert len(got) == len({p for p, _ in rows if p})
    assert got["LICENSE"] == ("MIT", "own", "") and got["a/b/x.py"] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert got["a/b/c/y.py"] == ("CC-BY-NC-4.0", "inherited", "a/b") and got["z.py"][:2] == ("Apache-2.0", "own")
    assert got["a/bb/q"][:2] == ("MIT", "own") and got["a/c"] == ("MIT", "inherited", "") and got["f/1"][1] == "inherited"
    assert license_scan.scan(empty(df)).count() == 0


def test_license_named_tagged_and_vague(spark):
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = {
        "Released under the ISC License.": "ISC", "Released under the BSD License.": "NOASSERTION", "Released under the Python License.": "Python-2.0",
        "Released under the Frobnicate License.": "NOASSERTION", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: (Apache-2.0 OR MIT)": "Apache-2.0",
        f"{prose} {prose} Released under the MIT License. {prose} {prose}": "MIT", f"{prose} Licensed under the Apache License, Version 2.0. {prose}": "Apache-2.0",
        f"/*\n * Licensed under the\n * Mozilla Public License, Version 1.1.\n * {prose}\n */": "MPL-1.1", "BSD 2-Clause": "BSD-2-Clause",
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        f"das Wort steht mit der Hand und mit der {prose}": None, "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "the license of the work": None,
    }
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(rows)] + [(f"x{i}", f"{prose} the license of this work {i}") for i in range(30)], "path string, text string")
    got = {r.path: r.license for r in license_scan.notices(df).collect()}
    assert {t: got.get(f"d{i}") for i, t in enumerate(rows)} == rows
    assert not any(k.startswith("x") for k in got)
    assert len({x for x, _ in (*license_scan.TEMPLATES, *license_scan.named_templates())}) >= 30


def test_license_cosine_by_brute_force(spark, documents):
    files = license_scan.document_paths(documents)
    templates = (*license_scan.TEMPLATES, *license_scan.named_templates())
    model = license_scan.weigh(files, templates)
    vectors: dict[int, dict] = {}
    for i, _, term, w in model.rows:
        vectors.setdefault(i, {})[term] = w
    want = {}
    for r in files.collect():
        words = re.findall("[a-z0-9]+", r.text.lower())
        for i, template in enumerate(model.words):  # every window of every template's size
            if not set(model.naming(i)) <= set(words):
                continue
            for at in range(max(1, len(words) - len(template) + 1)):
                window = words[at:at + len(template)]
                if not set(model.naming(i)) <= set(window) or not set(window) & set(template):
                    continue
                w = {t: (1 + np.log(n)) * model.idf.get(t, model.other) for t, n in Counter(window).items()}
                cosine = sum(x * vectors[i].get(t, 0) for t, x in w.items()) / np.sqrt(sum(x * x for x in w.values()))
                if cosine >= license_scan.THRESHOLD:
                    want[r.path] = max(want.get(r.path, (0,)), (round(cosine, 6), templates[i][0]))
    got = {r.path: (round(r.similarity, 6), r.license) for r in license_scan.notices(files).where("similarity is not null").collect()}
    assert got == want and want


# Decontamination


def tokens(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def grams(w):
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_leaks(docs, items):
    out = {}
    for i, t in docs:
        w = tokens(t)
        for item, text in items:
            v = tokens(text)
            if i is None or not w or not v or not grams(w) & grams(v):
                continue
            best = 0
            for k in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[k:k + len(v)]), grams(v)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[i, item] = round(best, 9)
    return out


def test_leaks(spark, documents, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    long_item = max(items, key=lambda x: len(tokens(x[1])))
    w = tokens(long_item[1])
    planted = [(900, "so " + " ".join(w[:-1]) + " end"), (901, " ".join(w[:len(w) // 2])), (902, " ".join(w).upper()), (902, long_item[1]), (None, long_item[1])]
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(planted, "doc_id long, text string"))
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], items)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == want and (900, long_item[0]) in want and (901, long_item[0]) not in want
    assert decontaminate.leaks(empty(docs), benchmark).count() == 0
    assert decontaminate.leaks(docs, empty(benchmark)).count() == 0


def test_blocks_fetch_everything_within_the_radius(spark):
    rng = random.Random(6)
    pairs = []
    for n in range(300):
        a, flips = rng.getrandbits(64), rng.sample(range(64), rng.randrange(decontaminate.RADIUS + 1))
        b = a
        for f in flips:
            b ^= 1 << f
        pairs.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(F.arrays_overlap(decontaminate.blocks("a"), decontaminate.blocks("b")).alias("met"))
    assert df.where("met").count() == 300


# Byte-level BPE


def test_bpe_like_the_library_and_back(spark, documents, odd):
    texts = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(data):
        return hashlib.sha256(data).hexdigest()

    def expected(i, text):
        ids = library.encode_ordinary(text or "")
        return i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())

    want = Counter(expected(r.doc_id, r.text) for r in texts.collect())
    assert Counter(tuple(r) for r in bpe.digests(texts, RANKS, public_tokenizers.PATTERN).collect()) == want
    assert bpe.digests(empty(odd), RANKS, public_tokenizers.PATTERN).count() == 0


# Substring dedup


def brute_dedup(rows, window=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = Counter()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def test_substring_dedup(spark, documents, odd):
    passage = " ".join(f"p{k}" for k in range(55))
    planted = spark.createDataFrame([(200 + i, f"own{i} {passage} rest{i}") for i in range(60)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(planted)
    want = brute_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(tuple(r) for r in substring_dedup.dedup(docs.repartition(7)).collect()) == want
    assert want[(259, 57, 55, "own59 rest59")] == 1
    assert substring_dedup.dedup(empty(odd)).count() == 0


def test_sketch_gaps_round_trip():
    cells = np.unique(np.random.default_rng(7).integers(0, 10**6, 3000)).astype(np.uint32)
    assert np.array_equal(substring_dedup._unpacked(substring_dedup._packed(cells)), cells)
    assert len(substring_dedup._unpacked(substring_dedup._packed(cells[:0]))) == 0


# HTML


def article(page):
    part = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL).group(1)
    part = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\0", part)))
    lines = (" ".join(html.unescape(x).split()) for x in part.split("\0"))
    return "\n".join(x for x in lines if x)


BODY = "".join(f"<p>Paragraph {i} of the article has some plain words, and then more.</p>" for i in range(6))
TEXT = "\n".join(f"Paragraph {i} of the article has some plain words, and then more." for i in range(6))


@pytest.mark.parametrize(
    "theme",
    [
        '<div class="has-sidebar"><div class="post">{}</div><div class="sidebar"><p>Other things to read</p></div></div>',
        '<div class="site no-sidebar">{}<div id="comments"><p>A reader says so</p></div></div>',
        '<div class="post no-comments">{}</div><div class="site-footer">All rights</div>',
        '<div class="entry-content social-proof">{}</div><div class="social-links"><a>Follow</a></div>',
        '<div class="article-form">{}</div><form>Your mail <input></form>',
        '<div class="search-results"><div>{}</div></div>',
        '<div class="hentry category-x tag-comment">{}</div><ol class="commentlist"><li class="comment">First!</li></ol>',
        '<div id="header">Site name</div><div class="Wrapper">{}</div><div class="article-footer">By someone</div>',
        '<ul class="mainNav"><li>Home</li><li>News</li></ul><div>{}</div><div class="adSlot">Buy now, cheap</div>',
        '<div class="cookie-notice"><p>We use cookies on this site</p></div><section>{}</section><div class="related-posts">More</div>',
        '<div class="modal-open">{}</div><div role="navigation">Next page</div><div class="post-comments"><p>Nice one, thanks a lot</p></div>',
    ],
)
def test_html_themes(theme):
    weights = html_text.Weights(2.0, {"p": -0.05, "/p": -0.05, "div": -0.3, "/div": -0.3, "li": -1.0, "a": -1.0})
    assert html_text.main_text(f"<html><body>{theme.format(BODY)}</body></html>", weights) == TEXT


def test_html_marks_on_small_elements():
    weights = html_text.Weights()
    page = f'<div>{BODY}<blockquote class="notice">A quoted word.</blockquote><p id="search">Look here.</p><div class="ad">Buy</div></div>'
    assert html_text.main_text(page, weights) == f"{TEXT}\nA quoted word.\nLook here."
    comments = f'<article><p>A short one.</p></article><div class="comments">{BODY * 5}</div>'
    assert html_text.main_text(comments, weights) == "A short one."


def test_html_region_is_the_best_of_all():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(rng.randint(0, 14))]
        every = [(sum(scores[b:e]), -e, b) for b in range(len(scores)) for e in range(b + 1, len(scores) + 1)]
        begin, end = html_text.best_region(scores)
        best = max(every, default=(0, 0, 0))
        assert sum(scores[begin:end]) == max(best[0], 0)
        if best[0] > 0:
            assert end == -best[1]  # the earliest end of the highest sum


def test_html_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_text.fit(pages)
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract(pages, weights).collect()} == want
    page = (
        '<html><head><title>x</title></head><body><div id="site-header">Hd</div><div class="cookie-notice">We use</div><div class="post">'
        '<h1>Title &amp; more</h1><p>One two&nbsp;three<br>four <a href="x">link</a>.</p><div class="ad-slot"><p>Buy <a href=q>now</a></p></div>'
        '<ul><li>a<li>b c</ul><p title="a>b">Last<p>Short</div><div class="sidebar">Side <p>x</div><section id="comments"><p>nice</p></section>'
        '<form>Mail <input> x</form><footer>f</footer><script>if(a<b){"</p>"}</script><!-- c <p>no</p> --></body></html>'
    )
    rows = [(1, None), (2, ""), (3, "plain <b>text"), (4, page), (4, page), (5, "<p>" + "word " * 40000), (6, "<nav>only</nav>"), (None, "<p>x < y")]
    df = spark.createDataFrame([(i, f"u{i}", h, 0) for i, h in rows], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df, weights).collect()]
    texts = {i: t for i, t, _ in got}
    assert len(got) == 8 and all(n == len(t) for _, t, n in got)
    assert texts[1] == texts[2] == texts[6] == "" and texts[3] == "plain text" and texts[None] == "x < y"
    assert texts[4] == "Title & more\nOne two three four link.\na\nb c\nLast\nShort" and len(texts[5]) == 5 * 40000 - 1
    assert html_text.extract(empty(df), html_text.fit(empty(df))).count() == 0
