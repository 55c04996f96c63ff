"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, with weights learned
from labelled pages: those whose markup names the article. One linear scan finds the contiguous
region of the highest sum. Menus, adverts and other marked parts count nothing and are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------
#: Elements that are never article text.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas nav header footer aside form button select "
    "textarea dialog menu".split()
)
#: Elements whose content is no markup.
RAW = "script style noscript template iframe textarea title svg"
#: Words of class, id and role that mark a part as no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promoted promotion banner "
    "menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside "
    "notice notices cookie cookies consent gdpr alert popup modal overlay paywall newsletter subscribe subscription "
    "signup login search share sharing social related recommended recommendations comment comments commentlist disqus "
    "reply replies respond form widget widgets toolbar pagination pager copyright disclaimer contentinfo complementary "
    "skip hidden".split()
)
#: Of these, the ones that may stand for something else where they are part of a longer name.
WEAK = frozenset(
    "search social share sharing form notice notices alert hidden skip subscribe subscription related promo promoted promotion "
    "banner widget widgets respond signup login copyright disclaimer modal overlay".split()
)
#: Of these, the ones that never name a wrapper of the whole page.
OWN = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored sponsors comment comments commentlist disqus reply replies".split()
)
#: First words of a name that turn its meaning, and words that name the article itself.
TURNS = frozenset("no not has with without is tag category type status format".split())
CONTENT = frozenset("article content entry hentry post story body text main page".split())
#: Elements that frame the page or quote, and are kept whatever their class says.
FRAMES = frozenset("html body main article blockquote".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of the same group.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# ----------------------------------------------------------------------------------------------
#: Pages learned from, and the tag names kept of them: the most frequent of at most so many letters.
PAGES, NAMES, LETTERS = 2000, 1000, 12
#: A marked element with more than this share of the page's words is a wrapper.
WRAPS = 0.9
#: Least cost of a tag, cost of one not met in labelled pages, and bounds of a word's score.
LEAST, UNSEEN, WORD = -0.02, -0.1, (0.5, 3.0)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW.split())})\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][a-z0-9]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)


@dataclass
class Weights:
    """The score of a word and of each tag."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        return self.tags.get(name, UNSEEN)


def _mark(name: str, attrs: str) -> int:
    """What class, id and role say of an element: 0 nothing, 1 no article text unless it wraps the page, 2 in any case.

    A name of one word is taken as it is. In a longer one the last word counts, or the first,
    unless the name opens with a word that turns it (``no-``, ``has-``); weak marks give way to
    any word on the element that names the article.
    """
    if not attrs or name in FRAMES:
        return 0
    names = [
        re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower())
        for m in _MARK.finditer(attrs) if not (name == "p" and m.group(1).lower() == "id")
        for part in m.group(2).strip("\"'").split()
    ]
    article = any(w in CONTENT for ws in names for w in ws)
    found = 0
    for ws in names:
        if not ws or (len(ws) > 1 and ws[0] in TURNS):
            continue
        for w in {ws[-1], ws[0]}:
            if w in MARKS and not ((w in WEAK or w != ws[-1]) and article):
                found = max(found, 2 if w in OWN else 1)
    return found


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(tag name or '' for text, text, in a dropped part, in an article) of a page in order.

    Text comes decoded; end tags come with a slash before the name.
    """
    stack: list[tuple[str, bool, bool, int]] = []
    dropped = inside = 0
    marks: list[tuple[int, ...]] = [()]  # of marked elements that are open, by their number
    kinds, words, whole = [0], [0], 0
    out: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []

    def pop() -> None:
        nonlocal dropped, inside
        _, was_dropped, was_inside, mark = stack.pop()
        dropped -= was_dropped
        inside -= was_inside
        if mark:
            marks.pop()

    for m in _TOKEN.finditer(page):
        if (text := m.group("text")) is not None:
            text = html.unescape(text)
            if not dropped:
                n = len(text.split())
                whole += n
                for k in marks[-1]:
                    words[k] += n
            out.append(("", text, dropped > 0, inside > 0, marks[-1]))
            continue
        if m.group("raw"):
            out.append((m.group("raw").lower(), "", True, inside > 0, marks[-1]))
            continue
        name = (m.group("name") or m.group("name2") or "").lower()
        if not name:
            continue
        if m.group("close") or m.group("close2"):
            out.append(("/" + name, "", dropped > 0, inside > 0, marks[-1]))
            if any(open_[0] == name for open_ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCKS and any(open_[0] == "p" for open_ in stack[-8:]):
            while stack[-1][0] != "p" and stack[-1][0] not in BLOCKS:
                pop()
            if stack[-1][0] == "p":
                pop()
        if name in SIBLINGS and stack and stack[-1][0] in SIBLINGS[name].split():
            pop()
        if name not in VOID:
            mark = _mark(name, m.group("attrs") or m.group("attrs2") or "")
            if mark:
                kinds.append(mark)
                words.append(0)
                marks.append((*marks[-1], len(kinds) - 1))
            stack.append((name, name in DROPPED, name in ("article", "main"), mark))
            dropped += name in DROPPED
            inside += name in ("article", "main")
        out.append((name, "", dropped > 0, inside > 0 and name not in ("article", "main"), marks[-1]))
    counts = [k == 2 or n <= WRAPS * whole for k, n in zip(kinds, words, strict=True)]
    return [(name, text, drop or any(counts[k] for k in of), within) for name, text, drop, within, of in out]


def learned(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log odds of each token inside against outside the article; '' stands for a word."""
    total = {side: sum(n for (_, s), n in counts.items() if s is side) + 1.0 for side in (True, False)}

    def odds(name: str) -> float:
        inside, outside = (counts.get((name, side), 0) + 0.5 for side in (True, False))
        return math.log(inside / total[True]) - math.log(outside / total[False])

    names = {name for name, _ in counts} - {""}
    word = min(max(odds(""), WORD[0]), WORD[1]) if counts else 1.0
    return Weights(word, {name: min(odds(name), LEAST) for name in names})


def counted(page: str) -> Counter:
    """(token, inside) counts of a labelled page, dropped parts left out."""
    out: Counter = Counter()
    for name, text, dropped, inside in tokens(page):
        if not dropped:
            out[name, inside] += len(text.split()) if not name else 1
    return out


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous region of the highest positive sum, the first of equals; (0, 0) without one."""
    best = total = 0.0
    start = begin = end = 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0.0:
            total, start = 0.0, i + 1
        elif total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def main_text(page: str, weights: Weights) -> str:
    """The words of the best region, white space as one space, blocks by line."""
    parts = tokens(page)
    begin, end = best_region(
        (LEAST if dropped else weights.tag(name)) if name else 0.0 if dropped else weights.word * len(text.split())
        for name, text, dropped, _ in parts
    )
    blocks: list[list[str]] = [[]]
    for name, text, dropped, _ in parts[begin:end]:
        if name:
            if name.removeprefix("/") in BLOCKS:
                blocks.append([])
            elif name == "br" or name.removeprefix("/") in ("td", "th"):
                blocks[-1].append(" ")
        elif not dropped:
            blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def fit(df: DataFrame, html_col: str = "html", id_col: str = "page_id", pages: int = PAGES) -> Weights:
    """Weights from at most ``pages`` pages that mark their article, the first by a hash of their id.

    Counts come to the driver by tag name: the ``NAMES`` most frequent of at most ``LETTERS``
    letters; any other name weighs what a name not met does.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    labelled = rows.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    # of bounded size: at most ``pages`` ids
    chosen = F.broadcast(labelled.select("id").where("id is not null").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(pages).distinct())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(counted(page))
            yield pd.DataFrame([(k, inside, n) for (k, inside), n in total.items()], columns=["name", "inside", "n"])

    sums = (
        labelled.join(chosen, "id").select("html").mapInPandas(run, "name string, inside boolean, n long")
        .where(F.length("name") <= LETTERS + 1).groupBy("name", "inside").agg(F.sum("n").alias("n"))
    )
    return learned({(r.name, r.inside): r.n for r in sums.orderBy(F.desc("n")).limit(NAMES).collect()})


def extract(
    df: DataFrame, weights: Weights, html_col: str = "html", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page, from the whole of its HTML.

    Null and empty pages, and pages without a word outside dropped parts, have an empty text.
    Headers go, also those inside an article. A class, id or role drops its element by
    :func:`_mark`, unless the element wraps nearly all words of the page.
    Of regions with one sum the first wins. A text may hold unclosed elements, comments and
    scripts that contain tags. Repeated rows and null ids give a row each. Extra columns are
    not read. Memory is in proportion to the longest page.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights) if p else "" for p in batch], dtype=object)

    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text_of("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
