"""Content operators for answer engines: trust signals, snippets, JSON-LD."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx
from kwloom.functions.literals import first_literals, needed


def trust_patterns(
    locale: str = "global",
    patterns: Mapping[str, tuple] = lx.TRUST_PATTERNS,
    locale_patterns: Mapping[str, Mapping[str, tuple]] = lx.TRUST_LOCALES,
) -> dict[str, list]:
    merged = {k: list(v) for k, v in patterns.items()}
    for category, extra in locale_patterns.get(locale, {}).items():
        merged.setdefault(category, []).extend(extra)
    return merged


def trust_signals(
    content: Column | str,
    locale: str = "global",
    patterns: Mapping[str, tuple] = lx.TRUST_PATTERNS,
    locale_patterns: Mapping[str, Mapping[str, tuple]] = lx.TRUST_LOCALES,
) -> Column:
    """Struct of category scores, the weighted score, signals found and missing, advice.

    One pass finds which patterns have a literal that they need in the text; only those run.
    """
    merged = trust_patterns(locale, patterns, locale_patterns)
    rules = [(c, p, d) for c, listed in merged.items() for p, d in listed]
    described = list(dict.fromkeys(d for _, _, d in rules))

    needs = [needed(p) or [""] for _, p, _ in rules]

    def judged(bound: Column) -> Column:
        text, may = bound["text"], bound["may"]
        return F.array(
            *[F.when(F.get(may, F.lit(i)).isNotNull(), text.rlike(tx.java_pattern(p))).otherwise(F.when(text.isNotNull(), False))
              for i, (_, p, _) in enumerate(rules)]
        )

    def signals(hits: Column) -> Column:
        def found(category: str | None = None) -> Column:
            return tx.compact(
                *[F.when(hits[i], F.lit(d)) for i, (c, _, d) in enumerate(rules) if category in (None, c)]
            )

        def score(category: str) -> Column:
            count = sum((hits[i].cast("int") for i, (c, _, _) in enumerate(rules) if c == category), F.lit(0))
            return F.least(count / F.lit(float(lx.TRUST_MAXIMUM[category])), F.lit(1.0))

        overall = F.lit(0.0)
        for category, weight in lx.TRUST_WEIGHT.items():
            overall = overall + F.lit(weight) * score(category)
        missing = F.slice(F.array_except(tx.literal_array(described), found()), 1, 10)
        advice = tx.compact(
            *[F.when(score(c) < 0.4, F.lit(line)) for c, line in lx.TRUST_ADVICE.items()]
        )
        return F.struct(
            F.round(overall, 3).alias("overall_score"),
            *[F.round(score(c), 3).alias(f"{c}_score") for c in lx.TRUST_WEIGHT],
            found().alias("signals_found"),
            missing.alias("signals_missing"),
            advice.alias("recommendations"),
        )

    # every pattern meets the text once: the hits are bound before they are used
    text = F.lower(tx.as_col(content))
    bound = F.struct(text.alias("text"), first_literals(text, needs).alias("may"))
    return tx.let(tx.let(bound, judged), signals)


def snippet(query: Column | str, query_type: Column | str, points: Column | str) -> Column:
    """Featured-snippet text laid out by query type."""
    title, kind, items = tx.title_case(query), tx.as_col(query_type), tx.as_col(points)

    def numbered(first: str, last: str, source: Column) -> Column:
        return F.transform(
            source,
            lambda p, i: F.concat(F.lit(first), (i + 1).cast("string"), F.lit(last), p),
        )

    def bullets(mark: str) -> Column:
        return F.transform(items, lambda p: F.concat(F.lit(mark), p))

    def stack(head: Column, lines: Column, gap: str) -> Column:
        return F.array_join(F.concat(F.array(head), lines), gap)

    heading = F.concat(F.lit("## "), title, F.lit("\n"))
    return (
        F.when(
            kind == "direct_answer",
            F.concat(title, F.lit("? "), F.coalesce(F.get(items, F.lit(0)), F.lit(""))),
        )
        .when(
            kind == "list",
            stack(
                F.concat(F.lit("**"), title, F.lit("**\n")),
                numbered("", ". ", F.slice(items, 1, 10)),
                "\n",
            ),
        )
        .when(kind == "tutorial", stack(heading, numbered("**Step ", ":** ", items), "\n\n"))
        .when(kind == "comparative", stack(heading, bullets("- "), "\n"))
        .otherwise(
            F.concat(
                title,
                F.lit(" involves the following key considerations:\n\n"),
                F.array_join(bullets("• "), "\n"),
            )
        )
    )


def citation_excerpt(content: Column | str, max_length: int = 300) -> Column:
    """Opening of a text, cut at a sentence end or a word for citation."""
    text = tx.strip(content)
    started = F.when(text.rlike(r"^\p{Lu}"), text).otherwise(
        F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    )
    head = F.substring(started, 1, max_length)
    # one-based positions of the last full stop and the last space; 0 when absent
    stop, gap = (
        F.when(F.instr(head, c) == 0, 0).otherwise(
            F.length(head) - F.locate(c, F.reverse(head)) + 1
        )
        for c in (".", " ")
    )
    cut = F.when(
        stop - 1 > max_length * 0.6, F.substr(head, F.lit(1), stop)
    ).otherwise(
        F.concat(F.when(gap > 0, F.substr(head, F.lit(1), gap - 1)).otherwise(head), F.lit("..."))
    )
    return F.when(F.length(started) > max_length, cut).otherwise(started)


# --- JSON-LD ---------------------------------------------------------------------------

SCHEMA_CONTEXT = "https://schema.org"


def _typed(type_name: Column | str, *fields: Column, context: bool = False) -> Column:
    kind = F.lit(type_name) if isinstance(type_name, str) else type_name
    head = [F.lit(SCHEMA_CONTEXT).alias("@context")] if context else []
    return F.struct(*head, kind.alias("@type"), *fields)


def _optional(col: Column | None, name: str) -> list[Column]:
    """A field that disappears from the JSON when blank."""
    return [] if col is None else [F.nullif(col.cast("string"), F.lit("")).alias(name)]


def faq_jsonld(pairs: Column | str) -> Column:
    """FAQPage from an array of (question, answer) structs."""
    entries = F.transform(
        tx.as_col(pairs),
        lambda p: _typed(
            "Question",
            p["question"].alias("name"),
            _typed("Answer", p["answer"].alias("text")).alias("acceptedAnswer"),
        ),
    )
    return F.to_json(_typed("FAQPage", entries.alias("mainEntity"), context=True))


def howto_jsonld(
    title: Column | str,
    steps: Column | str,
    description: Column | None = None,
    total_time: Column | None = None,
    image_url: Column | None = None,
) -> Column:
    entries = F.transform(
        tx.as_col(steps),
        lambda s, i: _typed("HowToStep", (i + 1).alias("position"), s.alias("text")),
    )
    return F.to_json(
        _typed(
            "HowTo",
            tx.as_col(title).alias("name"),
            entries.alias("step"),
            *_optional(description, "description"),
            *_optional(total_time, "totalTime"),
            *_optional(image_url, "image"),
            context=True,
        )
    )


def business_jsonld(
    name: Column | str,
    business_type: str = "HomeAndConstructionBusiness",
    address: Column | None = None,
    phone: Column | None = None,
    url: Column | None = None,
    price_range: Column | None = None,
    rating: Column | None = None,
    review_count: Column | None = None,
    services: Column | None = None,
) -> Column:
    """LocalBusiness; ``address`` is a struct with the four postal fields."""
    fields = [tx.as_col(name).alias("name")]
    if address is not None:
        place = _typed(
            "PostalAddress",
            *[
                address[f].alias(f)
                for f in ("streetAddress", "addressLocality", "addressRegion")
            ],
            F.coalesce(address["addressCountry"], F.lit("AE")).alias("addressCountry"),
        )
        fields.append(F.when(address.isNotNull(), place).alias("address"))
    fields += _optional(phone, "telephone") + _optional(url, "url")
    fields += _optional(price_range, "priceRange")
    if rating is not None and review_count is not None:
        stars = _typed(
            "AggregateRating",
            rating.alias("ratingValue"),
            review_count.alias("reviewCount"),
            F.lit(5).alias("bestRating"),
        )
        fields.append(F.when((rating != 0) & (review_count > 0), stars).alias("aggregateRating"))
    if services is not None:
        offers = F.transform(
            services,
            lambda s: _typed("Offer", _typed("Service", s.alias("name")).alias("itemOffered")),
        )
        catalog = _typed(
            "OfferCatalog", F.lit("Services").alias("name"), offers.alias("itemListElement")
        )
        fields.append(F.when(F.size(services) > 0, catalog).alias("hasOfferCatalog"))
    return F.to_json(_typed(business_type, *fields, context=True))


def service_jsonld(
    service: Column | str,
    provider: Column | str,
    description: Column | None = None,
    area_served: Column | None = None,
    price_from: Column | None = None,
    currency: str = "AED",
) -> Column:
    fields = [
        tx.as_col(service).alias("name"),
        _typed("Organization", tx.as_col(provider).alias("name")).alias("provider"),
        *_optional(description, "description"),
    ]
    if area_served is not None:
        areas = F.transform(area_served, lambda a: _typed("City", a.alias("name")))
        fields.append(F.when(F.size(area_served) > 0, areas).alias("areaServed"))
    if price_from is not None:
        price = _typed(
            "PriceSpecification",
            price_from.alias("price"),
            F.lit(currency).alias("priceCurrency"),
            price_from.alias("minPrice"),
        )
        offer = _typed("Offer", price.alias("priceSpecification"))
        fields.append(F.when(price_from.isNotNull(), offer).alias("offers"))
    return F.to_json(_typed("Service", *fields, context=True))


def script_tag(json_ld: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">\n'), json_ld, F.lit("\n</script>"))
