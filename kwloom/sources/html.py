"""Web pages to text.

One ``mapInPandas`` pass turns each page into two flat arrays: its elements and its text
runs, each run with the path of elements around it. Every rule after that is a Column.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx

# tasks get this module by value, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: elements without a closing tag ---
VOID_TAGS = frozenset(
    """
    area base br col embed hr img input keygen link menuitem meta param source track wbr
    basefont bgsound command frame image isindex nextid spacer
    """.split()
)

ELEMENT = "struct<id:int,path:array<int>,tag:string,cls:string,ident:string,attrs:string,name:string,content:string,chars:int,linked:int>"
RUN = "struct<path:array<int>,text:string>"


class _Flattener(HTMLParser):
    """Collects elements and text runs; an end tag closes back to its nearest open tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple] = []
        self.runs: list[tuple] = []
        self._open: list[tuple[int, str]] = []
        self._buffer: list[str] = []

    def _flush(self) -> None:
        text = "".join(self._buffer).strip()
        self._buffer.clear()
        if text:
            self.runs.append(([i for i, _ in self._open], text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        known = {k: v or "" for k, v in reversed(attrs)}
        number = len(self.elements)
        markup = " ".join([tag, *(f"{k}={v}" for k, v in known.items())])
        self.elements.append(
            (
                number, [*(i for i, _ in self._open), number], tag,
                known.get("class", ""), known.get("id", ""), markup,
                known.get("name", ""), known.get("content", ""),
            )
        )
        if tag not in VOID_TAGS:
            self._open.append((number, tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self._open and self._open[-1] == (len(self.elements) - 1, tag):
            self._open.pop()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][1] == tag:
                del self._open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self._buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def close(self) -> None:
        super().close()
        self._flush()


def _flatten(html: str | None) -> tuple[list, list]:
    parser = _Flattener()
    parser.feed(html or "")
    parser.close()
    return _measured(parser.elements, parser.runs), parser.runs


def _measured(elements: list[tuple], runs: list[tuple]) -> list[tuple]:
    """Elements with the length of their text and of the text in links below them.

    One walk up from every run, so a page costs its runs times their depth.
    """
    chars, linked = [0] * len(elements), [0] * len(elements)
    for path, text in runs:
        links = 0
        for i in reversed(path):
            chars[i] += len(text)
            linked[i] += links * len(text)
            links += elements[i][2] == "a"
    return [(*e, c, n) for e, c, n in zip(elements, chars, linked)]


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, elements, runs) of a (page_id, url, html) table."""
    kept = pages.select("page_id", "url", "html")
    page_type, url_type = (dict(kept.dtypes)[c] for c in ("page_id", "url"))

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("id", "path", "tag", "cls", "ident", "attrs", "name", "content", "chars", "linked")
        for batch in batches:
            parsed = [_flatten(h) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "elements": [[dict(zip(names, e)) for e in els] for els, _ in parsed],
                    "runs": [[{"path": p, "text": t} for p, t in runs] for _, runs in parsed],
                }
            )

    schema = f"page_id {page_type}, url {url_type}, elements array<{ELEMENT}>, runs array<{RUN}>"
    return kept.mapInPandas(flatten, schema)


def _ids(elements: Column) -> Column:
    return F.transform(elements, lambda e: e["id"])


def _without(items: Column, removed: Column) -> Column:
    """Runs or elements outside every removed element."""
    return tx.let(
        removed, lambda gone: F.filter(items, lambda r: ~F.arrays_overlap(r["path"], gone))
    )


def _inside(runs: Column, element: Column) -> Column:
    return F.filter(runs, lambda r: F.array_contains(r["path"], element["id"]))


def _length(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r["text"]))


def _joined(runs: Column, gap: str) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), gap)


def _marked(element: Column, markers: Iterable[str]) -> Column:
    pattern = tx.alternatives(markers)
    return F.lower(element["cls"]).rlike(pattern) | F.lower(element["ident"]).rlike(pattern)


def _mentions_chat(element: Column, elements: Column) -> Column:
    """An attribute or tag of the element or of anything inside names WhatsApp."""
    return F.exists(
        elements,
        lambda e: F.array_contains(e["path"], element["id"])
        & F.lower(e["attrs"]).rlike(r"wa\.me|whatsapp"),
    )


def _noise_ids(elements: Column) -> Column:
    return _ids(
        F.filter(
            elements,
            lambda e: e["tag"].isin(*lx.DROPPED_TAGS, *lx.CHROME_TAGS)
            | _marked(e, lx.NOISE_MARKERS),
        )
    )


def _contact_ids(elements: Column, runs: Column, removed: Column) -> Column:
    """Short links, spans and boxes that hold a chat link or a phone number."""

    def is_contact(e: Column, kept: Column) -> Column:
        text = tx.let(_inside(runs, e), lambda r: _joined(r, ""))
        chat = _mentions_chat(e, kept) | F.lower(text).rlike(r"wa\.me|whatsapp")
        phone = text.rlike(f"^(?:{tx.alternatives(lx.PHONE_PREFIXES)})") & (F.length(text) < 20)
        return F.length(text).between(3, 500) & (chat | phone)

    def contacts(all_kept: Column) -> Column:
        boxes = F.filter(all_kept, lambda e: e["tag"].isin("a", "span", "div"))
        return _ids(F.filter(boxes, lambda e: is_contact(e, all_kept)))

    return tx.let(_without(elements, removed), contacts)


def _short_links(elements: Column, runs: Column) -> Column:
    """Links and buttons followed by a separator because their text is short."""
    links = F.filter(elements, lambda e: e["tag"].isin("a", "button"))
    return F.filter(links, lambda e: _length(_inside(runs, e)).between(1, 29))


def _separated(runs: Column, links: Column) -> Column:
    """Runs with a ``|`` run added right after the last run of each short link."""

    def with_bars(all_runs: Column, short: Column) -> Column:
        def expand(run: Column, i: Column) -> Column:
            after = F.coalesce(F.get(all_runs, i + 1)["path"], F.array().cast("array<int>"))
            closing = F.filter(
                short,
                lambda e: F.array_contains(run["path"], e["id"])
                & ~F.array_contains(after, e["id"]),
            )
            # an inner link closes before the link around it
            bars = F.transform(
                F.reverse(closing),
                lambda e: F.struct(
                    F.slice(e["path"], F.lit(1), F.size(e["path"]) - 1).alias("path"),
                    F.lit("|").alias("text"),
                ),
            )
            return F.concat(F.array(run), bars)

        return F.flatten(F.transform(all_runs, expand))

    return tx.let(runs, lambda all_runs: tx.let(links, lambda short: with_bars(all_runs, short)))


def link_share(element: Column, elements: Column, runs: Column) -> Column:
    """Share of an element's text that sits in links; 1 for an empty element."""
    links = F.filter(
        elements,
        lambda e: (e["tag"] == "a")
        & F.array_contains(e["path"], element["id"])
        & (e["id"] != element["id"]),
    )
    linked = F.aggregate(links, F.lit(0), lambda n, e: n + _length(_inside(runs, e)))
    total = _length(_inside(runs, element))
    return F.when(total == 0, F.lit(1.0)).otherwise(linked / total)


def _share(element: Column) -> Column:
    """``link_share`` of an element of a page as parsed, from the lengths the parser counted."""
    return F.when(element["chars"] == 0, F.lit(1.0)).otherwise(element["linked"] / element["chars"])


def _link_heavy_ids(elements: Column, runs: Column, threshold: float) -> Column:
    boxes = F.filter(elements, lambda e: e["tag"].isin("div", "section", "ul", "ol"))
    return _ids(
        F.filter(
            boxes,
            lambda e: (_length(_inside(runs, e)) >= 20) & (link_share(e, elements, runs) > threshold),
        )
    )


def cleaned_runs(parsed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Replace ``runs`` by the runs that survive noise, contact and link-density rules."""
    removed = F.col("_removed")
    return (
        parsed.withColumn("_removed", _noise_ids(F.col("elements")))
        .withColumn("runs", _without(F.col("runs"), removed))
        .withColumn("_contacts", _contact_ids(F.col("elements"), F.col("runs"), removed))
        .withColumn("runs", _without(F.col("runs"), F.col("_contacts")))
        .withColumn("_gone", F.concat("_removed", "_contacts"))
        .withColumn("_kept", _without(F.col("elements"), F.col("_gone")))
        .withColumn("runs", _separated(F.col("runs"), _short_links(F.col("_kept"), F.col("runs"))))
        .withColumn("_heavy", _link_heavy_ids(F.col("_kept"), F.col("runs"), threshold))
        .withColumn("runs", _without(F.col("runs"), F.col("_heavy")))
        .withColumn("elements", _without(F.col("_kept"), F.col("_heavy")))
        .drop("_removed", "_contacts", "_gone", "_kept", "_heavy")
    )


def _tagged(tag: str) -> Column:
    return F.filter("elements", lambda e: e["tag"] == tag)


def _texts_of(tag: str, gap: str) -> Column:
    return F.transform(_tagged(tag), lambda e: _joined(_inside(F.col("runs"), e), gap))


def visible_text(parsed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, text): block texts in tag order, each distinct line once."""
    blocks = F.concat(*[_texts_of(tag, " ") for tag in lx.TEXT_TAGS])
    cleaned = cleaned_runs(parsed, threshold).withColumn(
        "lines", F.filter(blocks, lambda t: F.length(t) > 5)
    )
    lowered = cleaned.withColumn("low", F.transform("lines", lambda t: F.lower(tx.strip(t))))
    # the first position of each distinct line, then the lines at those positions
    firsts = F.transform(F.array_distinct("low"), lambda t: F.array_position("low", t))
    return lowered.withColumn("firsts", firsts).select(
        "page_id",
        "url",
        F.array_join(F.transform("firsts", lambda i: F.get("lines", i.cast("int") - 1)), "\n").alias("text"),
    )


def page_title(parsed: DataFrame) -> DataFrame:
    """(page_id, url, title): the title element's text, else the URL."""
    first = F.get(_tagged("title"), F.lit(0))
    text = tx.let(first, lambda e: _joined(_inside(F.col("runs"), e), ""))
    return parsed.select("page_id", "url", F.when(first.isNotNull(), text).otherwise(F.col("url")).alias("title"))


def link_density(parsed: DataFrame) -> DataFrame:
    """(page_id, element, tag, chars, density, link_heavy) of the boxes of each page."""
    boxes = F.filter("elements", lambda e: e["tag"].isin("div", "section", "ul", "ol"))
    rows = F.transform(
        boxes,
        lambda e: F.struct(
            e["id"].alias("element"),
            e["tag"].alias("tag"),
            e["chars"].alias("chars"),
            _share(e).alias("density"),
        ),
    )
    return parsed.select("page_id", F.explode(rows).alias("b")).select(
        "page_id", "b.*", ((F.col("b.chars") >= 20) & (F.col("b.density") > 0.5)).alias("link_heavy")
    )


def content_blocks(parsed: DataFrame) -> DataFrame:
    """(page_id, element, tag, is_content): is an element a content container?"""
    rows = F.transform(
        "elements",
        lambda e: F.struct(
            e["id"].alias("element"),
            e["tag"].alias("tag"),
            e["chars"].alias("chars"),
            _share(e).alias("density"),
            _marked(e, lx.CONTENT_MARKERS).alias("positive"),
            _marked(e, lx.CHROME_MARKERS).alias("negative"),
        ),
    )
    verdict = (
        F.when(F.col("b.chars") < 50, False)
        .when(F.col("b.negative") | (F.col("b.density") > 0.5), False)
        .when(F.col("b.positive"), True)
        .otherwise((F.col("b.chars") > 200) & (F.col("b.density") < 0.3))
    )
    return parsed.select("page_id", F.explode(rows).alias("b")).select(
        "page_id", "b.element", "b.tag", verdict.alias("is_content")
    )


def weighted_text(parsed: DataFrame, weights: tuple = lx.TAG_WEIGHTS) -> DataFrame:
    """(page_id, source, text, weight): title, description, headings and body texts."""
    dropped = _ids(F.filter("elements", lambda e: e["tag"].isin(*lx.WEIGHTED_DROPPED_TAGS)))
    kept = (
        parsed.withColumn("_dropped", dropped)
        .withColumn("runs", _without(F.col("runs"), F.col("_dropped")))
        .withColumn("elements", _without(F.col("elements"), F.col("_dropped")))
    )

    def entries(source: str, weight: float, texts: Column) -> Column:
        return F.transform(
            texts,
            lambda t: F.struct(
                F.lit(source).alias("source"), t.alias("text"), F.lit(weight).alias("weight")
            ),
        )

    parts = []
    for source, weight in weights:
        if source == "title":
            texts = F.filter(F.slice(_texts_of("title", ""), 1, 1), lambda t: t != "")
        elif source == "meta":
            found = F.slice(
                F.filter("elements", lambda e: (e["tag"] == "meta") & (e["name"] == "description")), 1, 1
            )
            texts = F.filter(F.transform(found, lambda e: tx.strip(e["content"])), lambda t: t != "")
        else:
            texts = F.filter(_texts_of(source, " "), lambda t: F.length(t) > 5)
        parts.append(entries(source, weight, texts))
    return kept.select("page_id", F.explode(F.concat(*parts)).alias("w")).select("page_id", "w.*")


def weighted_terms(texts: DataFrame, text_col: str = "text", weight_col: str = "weight") -> DataFrame:
    """(term, weight): occurrences of each a-z term of two or more letters times weight."""
    found = F.regexp_extract_all(
        F.lower(text_col), F.lit(tx.java_pattern(r"\b[a-z]{2,}\b")), F.lit(0)
    )
    return (
        texts.select(F.explode(found).alias("term"), F.col(weight_col).alias("w"))
        .groupBy("term")
        .agg(F.sum("w").alias("weight"))
    )
