"""Gazetteer tagging as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx
from kwloom.functions.literals import first_literals

KINDS = (
    "alias", "emirate", "district", "landmark", "free_zone",
    "government", "certification", "legal", "construction",
)
LOCAL_KINDS = ("alias", "emirate", "district", "landmark", "free_zone", "government", "legal")
CONTRACTING_KINDS = ("government", "certification", "legal", "construction")
REGION_ORDER = (
    "alias", "emirate", "district", "landmark", "free_zone",
    "government", "certification", "legal",
)


def extract_entities(
    keyword: Column | str,
    geo: str = "ae",
    gazetteer: tuple = lx.GAZETTEER,
    match: str = "substring",
) -> Column:
    """First gazetteer hit of each kind, the region and two flags, as a struct.

    Entries are tried in their listed order. ``match="token"`` wants whole words. One automaton
    has all entries, so a longer gazetteer costs no more a keyword.
    """
    kw = F.lower(tx.as_col(keyword))
    if match == "token":
        kw = F.concat(F.lit(" "), F.regexp_replace(kw, rf"{tx.SPACE}+", " "), F.lit(" "))
    listed = {kind: [g for g in gazetteer if g[0] == kind] for kind in (KINDS if geo.lower() == "ae" else ())}
    listed = {kind: entries for kind, entries in listed.items() if entries}
    fence = " {} ".format if match == "token" else str
    kinds = list(listed)

    def described(at: Column) -> Column:
        def hit(kind: str) -> Column:
            return F.get(at, F.lit(kinds.index(kind)))

        def part(kind: str, field: int) -> Column:
            if kind not in listed:
                return F.lit(None).cast("string")
            values = ["" if e[field] is None else e[field] for e in listed[kind]]
            return F.nullif(F.get(tx.literal_array(values), hit(kind)), F.lit(""))

        def any_of(some: tuple) -> Column:
            found = F.lit(False)
            for kind in some:
                if kind in listed:
                    found = found | hit(kind).isNotNull()
            return found

        display, region, type_name = 2, 3, 4
        return F.struct(
            F.coalesce(*[part(k, region) for k in REGION_ORDER]).alias("emirate"),
            part("district", display).alias("district"),
            part("landmark", display).alias("landmark"),
            part("free_zone", display).alias("free_zone"),
            part("government", display).alias("government_entity"),
            part("certification", display).alias("certification"),
            part("legal", display).alias("legal_term"),
            part("construction", display).alias("construction_term"),
            # a free zone's type replaces the district's even when it is unknown
            (
                F.when(hit("free_zone").isNotNull(), part("free_zone", type_name)).otherwise(part("district", type_name))
                if "free_zone" in listed
                else part("district", type_name)
            ).alias("location_type"),
            any_of(LOCAL_KINDS).alias("is_local"),
            any_of(CONTRACTING_KINDS).alias("is_contracting"),
        )

    if not kinds:
        return described(F.array().cast("array<int>"))
    return tx.let(first_literals(kw, [[fence(e[1].lower()) for e in listed[k]] for k in kinds]), described)


def location_key(entities: Column) -> Column:
    """District, else region, else the country when local; everything else is global."""
    return F.when(
        entities["is_local"],
        F.coalesce(entities["district"], entities["emirate"], F.lit("UAE")),
    ).otherwise(F.lit("global"))


def location_variations(
    keyword: Column | str,
    include_emirates: bool = True,
    include_districts: bool = False,
    primary_emirate: str = "dubai",
    emirates: tuple = lx.EMIRATES,
    gazetteer: tuple = lx.GAZETTEER,
) -> Column:
    """Array of location variants of a keyword, the keyword first."""
    text = tx.as_col(keyword)
    endings = [e for key, _ in emirates for e in (key, f"in {key}")] if include_emirates else []
    if include_districts and primary_emirate:
        region = dict(emirates).get(primary_emirate)
        endings += [g[1] for g in gazetteer if g[0] == "district" and g[3] == region]
    variants = F.transform(tx.literal_array(endings), lambda e: F.concat_ws(" ", text, e))
    return F.concat(F.array(text), variants)
