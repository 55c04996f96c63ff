"""Sitemap XML kept in a table (sitemap_url, xml)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.functions import text as tx
from kwloom.operators.common import cut_lineage


def _locations(parent: str) -> Column:
    path = f"//*[local-name()='{parent}']/*[local-name()='loc']/text()"
    found = F.transform(F.xpath("xml", F.lit(path)), tx.strip)
    return F.filter(found, lambda u: u != "")


def well_formed(xml: Column | str) -> Column:
    """Whether a document parses; false for null and empty ones."""
    bad = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_xml(tx.as_col(xml), "_bad string", bad)
    return F.coalesce((F.trim(tx.as_col(xml)) != "") & parsed["_bad"].isNull(), F.lit(False))


def malformed(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url) of the documents that do not parse; the walk skips them."""
    return sitemaps.where(~well_formed("xml")).select("sitemap_url")


def _opened(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, children, urls): an index contributes only its children.

    A document that does not parse contributes nothing.
    """
    sitemaps = cut_lineage(sitemaps.where(well_formed("xml")))
    children = _locations("sitemap")
    is_index = F.size(F.xpath("xml", F.lit("//*[local-name()='sitemap']"))) > 0
    return sitemaps.select(
        "sitemap_url",
        F.when(is_index, children).otherwise(tx.literal_array([])).alias("children"),
        F.when(is_index, tx.literal_array([])).otherwise(_locations("url")).alias("urls"),
    )


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, url) reached from root sitemaps, following index files level by level.

    One equi-join per level; a sitemap already seen from the same root is not opened
    again, so a cycle ends the walk.
    """
    opened = cut_lineage(_opened(sitemaps))
    frontier = roots.select(F.col("sitemap_url").alias("root"), "sitemap_url").distinct()
    seen, found = frontier, None
    while True:
        level = cut_lineage(frontier.join(opened, "sitemap_url"))
        urls = level.select("root", F.explode("urls").alias("url"))
        found = urls if found is None else found.unionByName(urls)
        children = level.select("root", F.explode("children").alias("sitemap_url")).distinct()
        frontier = cut_lineage(children.join(seen, ["root", "sitemap_url"], "left_anti"))
        if frontier.isEmpty():
            return found
        seen = seen.unionByName(frontier)
