"""DuckDB statements that compute the registered queries independently.

Each statement is assembled from common table expressions; word lists are written into
the SQL as literals.
"""

from __future__ import annotations

from collections.abc import Iterable

from kwloom import lexicon as lx
from workload import lexicons as wl

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def s(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def arr(values: Iterable[str]) -> str:
    values = list(values)
    return "[" + ", ".join(s(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def tup(values: Iterable[str]) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def clean(x: str, digits: bool = True) -> str:
    keep = rf"{NON_WORD}+" if digits else r"[^\p{L}\p{Nl}\p{No}_]+"
    return f"trim(regexp_replace(lower({x}), '{keep}', ' ', 'g'))"


def contains_any(x: str, terms: Iterable[str]) -> str:
    terms = list(terms)
    return "(" + " OR ".join(f"contains({x}, {s(t)})" for t in terms) + ")" if terms else "false"


def any_token(x: str, terms: Iterable[str]) -> str:
    terms = list(terms)
    return f"list_has_any({x}, {arr(terms)})" if terms else "false"


def alt(terms: Iterable[str]) -> str:
    out = []
    for t in terms:
        out.append("".join("\\" + c if c in r".+*?()[]{}|^$\-" else c for c in t))
    return "|".join(out)


def re2(pattern: str) -> str:
    r"""A pattern without look-around: ``\b`` becomes a consumed non-word or an end."""
    if "(?=" in pattern:
        head, tail = pattern.split("(?=")
        tail = tail.rstrip(")").removeprefix(".*").removeprefix(r"\b")
        return re2(head).removesuffix(rf"({NON_WORD}|$)") + rf"({NON_WORD}.*)?{NON_WORD}" + re2(tail)
    out, i = "", 0
    parts = pattern.split(r"\b")
    for i, part in enumerate(parts):
        out += part
        if i < len(parts) - 1:
            opens = parts[i + 1] != "" and not parts[i + 1].startswith((".*", "\\s")) and (i == 0 and part == "")
            out += rf"(^|{NON_WORD})" if opens else rf"({NON_WORD}|$)"
    return out


def title(x: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), "
        "lambda r: CASE WHEN substring(r, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substring(r, 1, 1)) END "
        "|| lower(substring(r, 2))), '')"
    )


def case(pairs: Iterable[tuple[str, str]], otherwise: str) -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"CASE {body} ELSE {otherwise} END" if body else otherwise


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


# --- shared tables --------------------------------------------------------------------------

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def define(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body, needs)


def with_tables(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTE[name][1]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select
    tables = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][0]})" for n in order)
    return f"WITH {tables}\n{select}"


define(
    "sent",
    f"""SELECT doc_id, unnest(range(len(l))) AS sent_no, unnest(l) AS sentence FROM (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(10), 'g'), chr(10)),
    lambda p: {strip('p')}), lambda p: p <> '') AS l FROM documents)""",
)
define(
    "content",
    f"""SELECT doc_id, sent_no, {clean('sentence')} AS c FROM sent
  WHERE len(string_split_regex(sentence, '{SPACE}+')) >= 3""",
    "sent",
)


def protect(x: str, phrases: Iterable[str], fold: str = "") -> str:
    longest = sorted(phrases, key=len, reverse=True)
    return (
        f"array_to_string(list_transform(string_split_regex(regexp_replace({x}, "
        f"'{fold}({alt(longest)})', chr(1) || '\\1' || chr(2), 'g'), '[\\x01\\x02]'), "
        "lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, ' ', '_') ELSE p END), '')"
    )


def restore(x: str, phrases: Iterable[str], fold: str = "") -> str:
    for p in phrases:
        old = p.replace(" ", "_")
        x = (
            f"regexp_replace({x}, {s('(?i)' + alt([old]))}, {s(p)}, 'g')"
            if fold
            else f"replace({x}, {s(old)}, {s(p)})"
        )
    return x


def grams(tokens: str, n: int) -> str:
    text = " || ' ' || ".join(f"{tokens}[i + {k}]" if k else f"{tokens}[i]" for k in range(n))
    return f"list_transform(range(1, greatest(len({tokens}) - {n - 2}, 1)), lambda i: {text})"


def edge_ok(x: str) -> str:
    stop = arr(lx.ENGLISH_STOPWORDS)
    return (
        f"NOT list_contains({stop}, split_part({x}, ' ', 1)) "
        f"AND NOT list_contains({stop}, split_part({x}, ' ', -1))"
    )


define(
    "toks",
    f"""SELECT doc_id, sent_no, list_filter(string_split({protect('c', lx.PROTECTED_PHRASES)}, ' '),
  lambda t: length(t) >= 2) AS t FROM content WHERE contains(c, ' ')""",
    "content",
)
define(
    "kw",
    f"""SELECT keyword, freq, df FROM (
  SELECT {restore('g', lx.PROTECTED_PHRASES)} AS keyword, freq, df FROM (
    SELECT g, count(*) AS freq, count(DISTINCT (doc_id, sent_no)) AS df FROM (
      SELECT doc_id, sent_no, unnest({grams('t', 2)}) AS g FROM toks
      UNION ALL SELECT doc_id, sent_no, unnest({grams('t', 3)}) AS g FROM toks)
    GROUP BY g HAVING count(DISTINCT (doc_id, sent_no)) >= 2))
  WHERE {edge_ok('keyword')}""",
    "toks",
)
define("cdoc", f"SELECT doc_id, source, lang, n_chars, {clean('text')} AS c FROM documents")
define(
    "dtoks",
    "SELECT doc_id, source, n_chars, list_filter(string_split(c, ' '), lambda t: length(t) >= 2) AS t FROM cdoc",
    "cdoc",
)
define(
    "sug",
    """SELECT split_part(keyword, ' ', 1) || ' ' || split_part(keyword, ' ', 2) AS query,
  CASE WHEN length(keyword) % 2 = 0 THEN 'en' ELSE 'ar' END AS lang, keyword AS suggestion
  FROM kw WHERE len(string_split(keyword, ' ')) > 2""",
    "kw",
)
PROBE = (
    "CASE WHEN len(string_split(keyword, ' ')) > 2 "
    "THEN split_part(keyword, ' ', 1) || ' ' || split_part(keyword, ' ', 2) ELSE keyword END"
)
define(
    "checked",
    f"""SELECT k.keyword, coalesce(bool_or(s.suggestion IS NOT NULL AND
    contains(' ' || s.suggestion || ' ', ' ' || k.keyword || ' ')), false) AS validated
  FROM (SELECT keyword, {PROBE} AS probe FROM kw) k LEFT JOIN sug s ON s.query = k.probe
  GROUP BY k.keyword""",
    "kw", "sug",
)
define(
    "uni",
    f"""SELECT term FROM (
    SELECT term, count(*) AS df FROM (
      SELECT unnest(list_distinct(string_split(c, ' '))) AS term FROM cdoc WHERE c <> '')
    WHERE term <> '' GROUP BY term)
  WHERE df / (SELECT count(*) FROM documents WHERE coalesce(text, '') <> '') >= {wl.UNIVERSAL_THRESHOLD}
    AND (SELECT count(*) FROM documents WHERE coalesce(text, '') <> '') >= 3
  UNION SELECT unnest({arr(wl.UNIVERSAL_DEFAULTS)})""",
    "cdoc",
)
define(
    "unic",
    """SELECT t.keyword, count(*) AS tokens, count(u.term) AS universal FROM (
    SELECT keyword, unnest(list_distinct(string_split(keyword, ' '))) AS term FROM kw) t
  LEFT JOIN uni u ON u.term = t.term GROUP BY t.keyword""",
    "kw", "uni",
)


def starts_any(x: str, terms: Iterable[str], suffix: str = "") -> str:
    return f"regexp_matches({x}, {s(f'^(?:{alt(terms)}){suffix}')})"


define(
    "flagged",
    f"""SELECT k.keyword, k.freq, k.df, c.validated,
    {starts_any('k.keyword', wl.QUESTION_LEADS, ' ')} AS is_question,
    split_part(k.keyword, ' ', 1) AS cluster
  FROM kw k JOIN checked c ON c.keyword = k.keyword""",
    "kw", "checked",
)

TOK = "string_split(keyword, ' ')"


def intent_cases(signals=wl.INTENT_SIGNALS) -> list[tuple[str, str, float]]:
    out = []
    for name, terms in wl.INTENT_RULES.items():
        phrases = [t for t in terms if " " in t]
        single = [t for t in terms if " " not in t]
        out.append((f"({contains_any('keyword', phrases)} OR {any_token(TOK, single)})", name, 1.0))
    for name, terms in signals.items():
        out.append((any_token(TOK, terms), name, 0.5))
    brands = [c.split(".")[0] for c in wl.COMPETITORS if c.strip()]
    out.append((contains_any("keyword", brands), "navigational", 0.8))
    return out


def intent_sql(signals=wl.INTENT_SIGNALS, value: str = "name", brands: bool = True) -> str:
    cases = intent_cases(signals)
    if not brands:
        cases = cases[:-1]
    if value == "name":
        return case([(c, s(n)) for c, n, _ in cases], "'informational'")
    return case([(c, f"{v}::DOUBLE") for c, _, v in cases], "0.1::DOUBLE")


def feature_parts(intent: str = "intent") -> list[tuple[str, str]]:
    hits = {f: contains_any("keyword", terms) for f, terms in wl.SERP_TRIGGERS}
    parts = [(cond, f) for f, cond in hits.items()]
    parts.append((f"({intent} = 'informational' AND NOT {hits['featured_snippet']})", "people_also_ask"))
    parts.append((f"({intent} IN ('transactional', 'commercial'))", "top_ads"))
    parts.append((f"({intent} = 'local' AND NOT {hits['local_pack']})", "local_pack"))
    return parts


def features_sql() -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN {s(f)} END" for c, f in feature_parts())
    return f"list_filter([{parts}], lambda f: f IS NOT NULL)"


def ctr_sql() -> str:
    out = "1.0::DOUBLE"
    for cond, f in feature_parts():
        impact = lx.SERP_FEATURE_IMPACT.get(f, 0.05)
        out = f"({out} * CASE WHEN {cond} THEN 1.0::DOUBLE - {impact}::DOUBLE ELSE 1.0::DOUBLE END)"
    return f"greatest(0.2::DOUBLE, least(1.0::DOUBLE, {out}))"


def commercial_sql(intent: str = "intent", geo: bool = True, niche: bool = True) -> str:
    base = case([(f"{intent} = {s(k)}", f"{v}::DOUBLE") for k, v in lx.INTENT_VALUE.items()], "0.1::DOUBLE")

    def bump(cond: str, v: float) -> str:
        return f"CASE WHEN {cond} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"

    def hits(group: str) -> str:
        return f"len(list_intersect(list_distinct({TOK}), {arr(wl.TRIGGERS[group])}))"

    out = f"({base} + {bump(contains_any('keyword', wl.TRIGGERS['transactional']), 0.3)})"
    out = f"({out} + least(0.2::DOUBLE, {hits('commercial')} * 0.1::DOUBLE))"
    out = f"({out} + least(0.15::DOUBLE, {hits('b2b')} * 0.1::DOUBLE))"
    if geo:
        out = f"({out} + {bump(contains_any('keyword', wl.TRIGGERS['local']), 0.15)})"
    if niche:
        out = f"({out} + {bump(contains_any('keyword', lx.NICHE_TERMS['contracting']), 0.1)})"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {out}))"


def volume_sql(total: str) -> str:
    body = (
        "(1.0::DOUBLE + ln(1.0::DOUBLE + greatest(1, freq))) "
        "* CASE WHEN is_question THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END "
        f"* (1.0::DOUBLE + 0.05::DOUBLE * greatest(0, len({TOK}) - 2)) "
        "* CASE WHEN validated THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    )
    return f"CASE WHEN {total} > 0 AND freq >= {total} * 0.8::DOUBLE THEN 0.1::DOUBLE ELSE {body} END"


def difficulty_sql(total: str, results: str = "NULL", heads: Iterable[str] = wl.HEAD_TERMS) -> str:
    return (
        f"CASE WHEN {total} > 0 AND freq >= {total} * 0.8::DOUBLE THEN 10.0::DOUBLE "
        f"WHEN coalesce({results}, 0) <> 0 THEN log10(greatest(10, {results})) "
        f"ELSE CASE WHEN len({TOK}) <= 2 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END "
        f"* CASE WHEN {contains_any('keyword', heads)} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END END"
    )


N_DOCS = "(SELECT count(*) FROM documents)"


def ranked(source: str, value: str) -> str:
    """Average-tie rank over the row count."""
    return (
        f"CASE WHEN (SELECT count(*) FROM {source}) <= 1 THEN 0.5::DOUBLE ELSE "
        f"(rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0::DOUBLE) "
        f"/ (SELECT count(*) FROM {source}) END"
    )


def spread(source: str, value: str) -> str:
    lo, hi = f"(SELECT min({value}) FROM {source})", f"(SELECT max({value}) FROM {source})"
    return f"({value} - {lo}) / (CASE WHEN {hi} > {lo} THEN {hi} - {lo} ELSE 1.0::DOUBLE END)"


define(
    "raw",
    f"""SELECT *, {intent_sql()} AS intent, {volume_sql(N_DOCS)} AS v,
    {difficulty_sql(N_DOCS)} AS d FROM flagged""",
    "flagged",
)
define(
    "measured",
    f"""SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {ranked('raw', 'v')})) AS relative_interest,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, {spread('raw', 'd')})) AS difficulty,
    {ctr_sql()} AS ctr_potential, {features_sql()} AS serp_features FROM raw""",
    "raw",
)

RELEVANCE = (
    "CASE WHEN intent IN ('transactional', 'commercial') THEN 1.0::DOUBLE "
    "WHEN intent IN ('informational', 'navigational') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END"
)
# the scored table uses the library's default signals, which the corpus never hits
define("raw0", CTE["raw"][0].replace(intent_sql(), intent_sql(lx.INTENT_SIGNALS)), "flagged")
define("measured0", CTE["measured"][0].replace("FROM raw)", "FROM raw0)").replace("FROM raw", "FROM raw0").replace("raw00", "raw0"), "raw0")
define(
    "items",
    f"""SELECT m.keyword, cluster, cluster AS parent_topic, intent,
    CASE intent WHEN 'informational' THEN 'TOFU' WHEN 'transactional' THEN 'BOFU' ELSE 'MOFU' END AS funnel_stage,
    relative_interest, difficulty, ctr_potential, serp_features, true AS estimated, validated,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN validated THEN x ELSE x * 0.09999999999999998::DOUBLE END))
      AS opportunity_score FROM (
    SELECT q.*, (b + b * (w * 0.25::DOUBLE))
        * (1.0::DOUBLE - least(u.universal * 0.3::DOUBLE, 0.9::DOUBLE)) AS x FROM (
      SELECT *, relative_interest * ctr_potential * (1.0::DOUBLE - difficulty) * {RELEVANCE} AS b,
        {commercial_sql()} AS w FROM measured0) q
    JOIN unic u ON u.keyword = q.keyword) m""",
    "measured0", "unic",
)

Q: dict[str, str] = {}


def add(name: str, select: str, *needs: str) -> None:
    Q[name] = with_tables(select, *needs)


def kw(name: str, *columns: str) -> None:
    add(name, f"SELECT keyword, {', '.join(columns)} FROM kw", "kw")


# --- A ---------------------------------------------------------------------------------------

add("a3_sitemap_urls", "SELECT 'index-' || page_id AS root, url FROM pages")
LISTED = (
    "SELECT regexp_replace(regexp_extract(lower(url), '^(https?://[^/]+)', 1), '^https?://', '') AS domain, "
    "CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS place, page_id AS pos, url FROM pages"
)
add(
    "a4_competitor_urls",
    f"""WITH listed AS ({LISTED}), best AS (SELECT domain, min(place) AS place FROM listed GROUP BY domain)
SELECT domain, url, pos FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.domain ORDER BY pos, url) AS r
  FROM listed l JOIN best b ON l.domain = b.domain AND l.place = b.place
  WHERE contains(lower(url), '/en/') OR contains(lower(url), '/fr/')) WHERE r <= 3""",
)
add(
    "a5_dedup_by_url",
    r"""SELECT url, min(page_id) AS ord FROM (
  SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\d+.*$', '') AS url FROM pages) GROUP BY url""",
)
add(
    "a5_add_unseen",
    """SELECT page_id, url FROM pages WHERE contains(url, '.com/')
UNION ALL SELECT page_id, url FROM pages p WHERE NOT EXISTS (
  SELECT 1 FROM pages q WHERE contains(q.url, '.com/') AND q.url = p.url)""",
)
add(
    "a6_seed_document",
    "SELECT doc_id::VARCHAR AS url, lang AS title, text FROM documents",
)
add(
    "a7_serp_results",
    """SELECT 'page ' || page_id AS query,
  CASE page_id % 3 WHEN 0 THEN 'serpapi' WHEN 1 THEN 'bing' ELSE 'free' END AS provider,
  i::BIGINT AS position, 'page ' || page_id AS title, url,
  CASE page_id % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE 'b' END AS snippet,
  CASE WHEN page_id % 3 = 2 THEN -1 ELSE page_id * 10 END AS total_results
FROM pages, (SELECT unnest([0, 1]) AS i) WHERE page_id % 3 <> 2 OR i = 0""",
)
add(
    "a8_related_questions",
    f"""SELECT conv_id || '-' || turn AS query, 0::BIGINT AS position,
  {strip("lower(CASE WHEN turn % 4 = 0 THEN '  How ' ELSE 'x ' END || text)")} AS question
FROM conversations WHERE conv_id % 2 = 0 OR turn % 4 = 0""",
)
add(
    "a9_suggestions",
    f"SELECT {PROBE} AS query, 2::BIGINT AS position, keyword AS suggestion FROM kw "
    f"WHERE keyword <> {PROBE}",
    "kw",
)
LANGS = case([(f"c = {s(k)}", s("|".join(v))) for k, v in lx.SUGGESTION_LANGUAGES.items()], "'en'")
add(
    "a9_suggestion_languages",
    f"SELECT country, {LANGS} AS languages FROM "
    "(SELECT substring(n_name, 1, 2) AS country, lower(substring(n_name, 1, 2)) AS c FROM nation)",
)
add(
    "a13_stage_latest",
    """SELECT user_id::VARCHAR AS run_id, event_type AS stage_name, max(ts) AS ts,
  max_by(event_id, ts) AS item_count FROM events GROUP BY ALL""",
)
add(
    "a13_completed_stages",
    """WITH f AS (SELECT user_id::VARCHAR AS run_id, event_type, min(ts) AS f FROM events GROUP BY ALL)
SELECT run_id, string_agg(event_type, '|' ORDER BY f, event_type) AS stages,
  max_by(event_type, f) AS last_stage FROM f GROUP BY run_id""",
)
add(
    "a14_run_retention",
    """SELECT run_id, status, updated_at FROM (
  SELECT *, row_number() OVER (ORDER BY updated_at DESC, run_id) AS r FROM (
    SELECT user_id::VARCHAR AS run_id, max(ts) AS updated_at,
      CASE WHEN max_by(event_type, ts) = 'purchase' THEN 'completed' ELSE 'running' END AS status
    FROM events GROUP BY user_id) WHERE status <> 'completed') WHERE r > 10""",
)

# --- B ---------------------------------------------------------------------------------------

ENTITY = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
add(
    "b2_page_title",
    "SELECT page_id, url, "
    + strip(ENTITY.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
    + " AS title FROM pages",
)
add(
    "b6_weighted_terms",
    f"""SELECT term, sum(w) AS weight FROM (
  SELECT unnest(list_filter(regexp_extract_all(lower(text), '{WORD}+'),
    lambda t: regexp_full_match(t, '[a-z]{{2,}}'))) AS term,
  CASE lang WHEN 'en' THEN 2.0::DOUBLE WHEN 'fr' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents) GROUP BY term""",
)

# --- C ---------------------------------------------------------------------------------------

add("c1_clean_text", f"SELECT doc_id, {clean('text')} AS clean, {clean('text', False)} AS no_digits FROM documents")
STOPPED = f"list_filter({words('c')}, lambda w: NOT list_contains({arr(lx.ENGLISH_STOPWORDS)}, w))"
add(
    "c2_tokenize",
    f"""SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n_tokens
FROM (SELECT doc_id, {STOPPED} AS t FROM cdoc)""",
    "cdoc",
)
add("c3_sentences", "SELECT doc_id, sent_no, sentence FROM sent", "sent")
add(
    "c4_protect_phrases",
    f"""SELECT doc_id, sent_no, protected, {restore('protected', wl.PROTECTED, '(?i)')} AS restored
FROM (SELECT *, {protect('sentence', wl.PROTECTED, '(?i)')} AS protected FROM sent)""",
    "sent",
)
add("c5_ngram_counts", "SELECT keyword, freq, df FROM kw", "kw")
define(
    "body",
    f"""SELECT doc_id, list_filter(string_split({protect('b', lx.PROTECTED_PHRASES)}, ' '), lambda t: length(t) >= 2) AS t
  FROM (SELECT doc_id, string_agg(c, ' ' ORDER BY sent_no) AS b FROM content GROUP BY doc_id)""",
    "content",
)
define(
    "tf",
    f"""SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest({grams('t', 2)}) AS term FROM body
    UNION ALL SELECT doc_id, unnest({grams('t', 3)}) AS term FROM body) GROUP BY ALL""",
    "body",
)
define(
    "top_terms",
    f"""SELECT doc_id, term, weight, rank FROM (
    SELECT doc_id, {restore('term', lx.PROTECTED_PHRASES)} AS term, weight, rank FROM (
      SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank
      FROM (SELECT t.doc_id, t.term, t.tf * (ln((1 + (SELECT count(*) FROM body)) / (1.0::DOUBLE + d.df)) + 1.0::DOUBLE) AS weight
        FROM tf t JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) d ON t.term = d.term))
    WHERE rank <= 20) WHERE {edge_ok('term')}""",
    "tf", "body",
)
add("c6_tfidf_top_terms", "SELECT doc_id, term, round(weight, 9) AS weight, rank FROM top_terms", "top_terms")


def artifact_sql(x: str, o: dict) -> str:
    t = words(x)
    codes, auth, pair = alt(o["codes"]), alt(o["auth_terms"]), alt(o["switch_codes"])
    sp, nw = SPACE, NON_WORD
    garbage = (
        f"^(?:{alt(o['navigation'])})$|^(?:{auth}){sp}|{sp}(?:{auth})$"
        f"|(^|{nw})(?:{alt(o['switches'])})({nw}|$)"
        f"|^(?:{alt(o['leads'])}){sp}+(?:{codes})(?:{sp}|$)|{sp}(?:{pair}){sp}(?:{pair})(?:{sp}|$)"
    )
    bare = f"^(?:.*{sp})?(?:{codes})$|^(?:{codes}){sp}"
    subst = f"len(list_filter({t}, lambda w: length(w) > 2 AND NOT list_contains({arr(o['artifact_tokens'])}, w)))"
    return (
        f"CASE WHEN regexp_matches({x}, {s(garbage)}) THEN true "
        f"WHEN regexp_matches({x}, {s(bare)}) THEN "
        f"NOT (len({t}) >= 2 AND list_contains({arr(o['prepositions'])}, {t}[-2])) "
        f"ELSE {subst} < CASE WHEN len({t}) <= 2 THEN 1 ELSE 2 END END"
    )


def stop_phrase_sql(x: str, o: dict) -> str:
    t = words(x)
    every = arr([*o["prefixes"], *o["geo_tokens"], *o["fillers"]])
    return (
        f"(len({t}) >= 2 AND ((list_contains({arr(o['prefixes'])}, {t}[1]) "
        f"AND len(list_filter({t}[2:], lambda w: NOT list_contains({arr(o['geo_tokens'])}, w))) = 0) "
        f"OR len(list_filter({t}, lambda w: NOT list_contains({every}, w))) = 0))"
    )


def numeric_sql(x: str) -> str:
    t = words(x)
    return (
        rf"(regexp_matches({x}, '^[\p{{Nd}}\s\p{{Z}}\x1c-\x1f\x85.-]+$') OR (len({t}) > 0 AND "
        rf"len(list_filter({t}, lambda w: regexp_matches(w, '^\p{{Nd}}+$'))) * 2 > len({t})))"
    )


def grammar_sql(x: str, starts: Iterable[str]) -> str:
    t = words(x)
    return f"(len({t}) >= 2 AND list_contains({arr(starts)}, {t}[1]))"


def conflict_sql(x: str, o: dict) -> str:
    named = f"len(list_filter({arr(o['cities'])}, lambda c: contains({x}, c)))"
    joins = s(" (?:" + alt(o["connectors"]) + ") ")
    return f"({named} > 1 AND NOT regexp_matches({x}, {joins}))"


def phrase_sql(x: str, o: dict) -> str:
    t = words(x)
    year = r"\p{Nd}{4}"
    names = arr(o["temporal_names"])
    temporal = (
        f"((list_contains({names}, {t}[1]) OR regexp_matches({t}[1], '^(?:{year}|q[1-4]|{year}-{year})$')) AND "
        f"len(list_filter({t}[2:], lambda w: NOT (list_contains({names}, w) OR regexp_matches(w, '^{year}$')))) = 0)"
    )
    weak = f"(len({t}) > 1 AND len(list_filter({t}, lambda w: NOT list_contains({arr(o['common_words'])}, w))) = 0)"
    return (
        rf"coalesce({x} = '' OR regexp_matches({x}, '^\p{{Nd}}+$') OR {temporal} OR {x} IN {tup(o['navigation'])} "
        f"OR list_contains({arr(o['prepositions'])}, {t}[-1]) OR {weak}, true)"
    )


DROPPED = " OR ".join(
    [
        artifact_sql("keyword", wl.ARTIFACT),
        grammar_sql("keyword", wl.INVALID_STARTS),
        conflict_sql("keyword", wl.CONFLICT),
        any_token(TOK, wl.NEGATIVE),
        stop_phrase_sql("keyword", wl.STOP_PHRASE),
        numeric_sql("keyword"),
    ]
)
add(
    "c7_extract_candidates",
    f"""SELECT keyword, min(origin)::BIGINT AS origin FROM (
  SELECT keyword, 0 AS origin FROM kw UNION ALL SELECT term, 1 FROM top_terms)
WHERE len(string_split(keyword, ' ')) >= 2 AND NOT ({DROPPED}) AND NOT contains(keyword, 'near me')
GROUP BY keyword""",
    "kw", "top_terms",
)
LINES = f"""SELECT conv_id * 1000 + turn AS batch_id, i AS line_no, {strip('lower(l)')} AS keyword, role FROM (
  SELECT conv_id, turn, role, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (
    SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations))"""
add(
    "c8_merge_candidates",
    f"""SELECT keyword, origin::BIGINT AS origin, min(ord) AS ord FROM (
  SELECT keyword, origin, ord, min(origin) OVER (PARTITION BY keyword) AS first FROM (
    SELECT keyword, 0 AS origin, freq AS ord FROM kw
    UNION ALL SELECT lower(p_name), 1, p_partkey FROM part
    UNION ALL SELECT keyword, 2, batch_id FROM (
      SELECT batch_id, keyword, row_number() OVER (PARTITION BY batch_id ORDER BY min(line_no)) AS p
      FROM ({LINES}) WHERE {n_words('keyword')} >= 2 GROUP BY batch_id, keyword) WHERE p <= 50))
WHERE origin = first GROUP BY keyword, origin""",
    "kw",
)
define(
    "counted",
    f"""SELECT g, count(*) AS n FROM (
    SELECT unnest(t) AS g FROM dtoks UNION ALL SELECT unnest({grams('t', 2)}) FROM dtoks
    UNION ALL SELECT unnest({grams('t', 3)}) FROM dtoks) GROUP BY g""",
    "dtoks",
)
add(
    "c9_keyword_freq",
    "SELECT k.keyword, coalesce(c.n, 0) AS freq FROM kw k LEFT JOIN counted c ON c.g = k.keyword",
    "kw", "counted",
)
kw("c10_is_question", f"{starts_any('keyword', wl.QUESTION_LEADS, ' ')} AS is_question")


def seed_sql(tokens: str, service, product, trades, goods) -> str:
    return case(
        [
            (any_token(tokens, service), "'service'"), (any_token(tokens, product), "'product'"),
            (any_token(tokens, trades), "'service'"), (any_token(tokens, goods), "'product'"),
        ],
        "'unknown'",
    )


kw("c11_seed_type", f"{seed_sql(TOK, wl.SERVICE, wl.PRODUCT, wl.TRADES, wl.GOODS)} AS seed_type")


def filled(templates: Iterable[str]) -> str:
    return f"list_transform({arr(templates)}, lambda t: trim(replace(replace(t, '{{s}}', sd), '{{a}}', au)))"


add(
    "c12_seed_expansions",
    f"""SELECT p_partkey, seed_type, unnest(range(len(l))) AS position, unnest(l) AS keyword FROM (
  SELECT p_partkey, seed_type, list_filter(list_transform(range(1, len(a) + 1), lambda i:
    CASE WHEN list_position(a, a[i]) = i AND len(string_split(a[i], ' ')) >= 2 THEN a[i] END), lambda x: x IS NOT NULL) AS l
  FROM (SELECT p_partkey, seed_type, list_concat({filled(lx.SEED_TEMPLATES)},
      CASE seed_type WHEN 'service' THEN {filled(lx.SERVICE_TEMPLATES)} WHEN 'product' THEN {filled(lx.PRODUCT_TEMPLATES)}
        ELSE {filled(lx.UNKNOWN_TEMPLATES)} END,
      CASE WHEN au <> '' THEN {filled(lx.AUDIENCE_TEMPLATES)} ELSE []::VARCHAR[] END) AS a
    FROM (SELECT p_partkey, {clean('p_name')} AS sd, {clean('p_type')} AS au,
      {seed_sql("string_split(lower(p_name), ' ')", ("ring", "bolt"), ("widget",), ("red",), ("small",))} AS seed_type FROM part)))""",
)
add(
    "c13_reference_phrases",
    f"""SELECT p_partkey, unnest(range(len(l))) AS position, unnest(l) AS phrase FROM (
  SELECT p_partkey, list_transform({arr(lx.REFERENCE_TEMPLATES)}, lambda t: replace(t, '{{s}}', lower(trim(p_name)))) AS l FROM part)""",
)

# --- D ---------------------------------------------------------------------------------------

kw("d1_scraping_artifact", f"{artifact_sql('keyword', wl.ARTIFACT)} AS dropped")
kw("d2_stop_phrase", f"{stop_phrase_sql('keyword', wl.STOP_PHRASE)} AS dropped")
add(
    "d3_numeric_noise",
    f"""SELECT doc_id, sent_no, {numeric_sql('sentence')} AS dropped, {numeric_sql('m')} AS number
FROM (SELECT *, regexp_replace(sentence, '\\p{{L}}+', '7', 'g') AS m FROM sent)""",
    "sent",
)
kw("d4_negative_sentiment", f"{any_token(TOK, wl.NEGATIVE)} AS dropped")
kw("d5_grammar_invalid", f"{grammar_sql('keyword', wl.INVALID_STARTS)} AS dropped")
define(
    "kwtags",
    f"""SELECT keyword, ws, list_transform(list_filter(ws, lambda w, i: i <= 3), lambda w: {{'token': w,
    'pos': CASE WHEN length(w) > 8 THEN 'NOUN' WHEN length(w) > 6 THEN 'ADJ' WHEN length(w) = 4 THEN 'X'
      WHEN length(w) < 3 THEN 'SCONJ' ELSE 'PROPN' END,
    'tag': CASE WHEN length(w) = 5 THEN 'DT' WHEN length(w) = 6 THEN 'NNS' ELSE 'FW' END}}) AS t
  FROM (SELECT keyword, {words('lower(keyword)')} AS ws FROM kw)""",
    "kw",
)
_NOUNS = f"""len(list_filter(t, lambda w: w.pos IN ('NOUN', 'PROPN') OR w.tag IN {tup(lx.NOUN_TAGS)}
  OR (regexp_full_match(w.token, '\\p{{Ll}}{{4,}}') AND w.pos NOT IN {tup(lx.OTHER_THAN_NOUNS)})))"""
add(
    "d5_grammar_tagged",
    f"""SELECT keyword, len(ws) >= 2 AND (list_contains({arr(wl.INVALID_STARTS)}, ws[1]) OR (NOT list_contains({arr(lx.VALID_STARTS)}, ws[1])
  AND (t[1].pos IN ('CCONJ', 'SCONJ') OR (t[1].tag IN {tup(lx.INVALID_START_TAGS)} AND NOT list_contains({arr(lx.VALID_STARTS)}, t[1].token))
    OR (len(list_filter(t, lambda w: w.pos = 'ADJ')) = 0 AND (
      (n > 2 AND NOT list_contains({arr(lx.NOUN_RUN_STARTS)}, ws[1]))
      OR (len(t) > 3 AND n >= len(t) - 1 AND NOT list_contains({arr([*lx.NOUN_RUN_STARTS, *lx.PATTERN_STARTS])}, ws[1]))))))) AS dropped
FROM (SELECT *, {_NOUNS} AS n FROM kwtags)""",
    "kwtags",
)
kw("d6_entity_conflict", f"{conflict_sql('keyword', wl.CONFLICT)} AS dropped")
MOVED = s(wl.MOVED_PHRASE)
HITS = f"(len(string_split(keyword, {MOVED})) - 1)"
VALID = f"({HITS} = 0 OR ({HITS} = 1 AND ends_with(keyword, {MOVED})))"
kw("d7_near_me_valid", f"{VALID} AS valid")
kw(
    "d8_near_me_fix",
    f"""CASE WHEN {HITS} > 1 THEN '<dropped>' WHEN {VALID} THEN keyword
  WHEN trim(replace(keyword, {MOVED}, '')) = '' THEN '<dropped>'
  ELSE trim(replace(keyword, {MOVED}, '')) || ' ' || {MOVED} END AS fixed""",
)
kw("d9_phrase_invalid", f"{phrase_sql('keyword', wl.PHRASE)} AS dropped")
add("d10_universal_terms", "SELECT term FROM uni", "uni")
add("d11_entirely_universal", "SELECT keyword, tokens = universal AS dropped FROM unic", "unic")
add(
    "d12_stem_dedup_sorted_words",
    """SELECT keyword, freq FROM (
  SELECT keyword, freq, row_number() OVER (PARTITION BY list_sort(string_split(keyword, ' '))
    ORDER BY freq % 3 DESC, length(keyword), keyword) AS r FROM kw) WHERE r = 1""",
    "kw",
)
kw(
    "d13_basic_filter",
    f"""(NOT {contains_any('keyword', [b.lower() for b in wl.BLACKLIST])} AND len({TOK}) BETWEEN 2 AND 3
  AND length(keyword) >= 8 AND NOT {phrase_sql('keyword', wl.PHRASE)}) AS kept""",
)

# --- E ---------------------------------------------------------------------------------------

kw("e1_intent", f"{intent_sql()} AS intent", f"{intent_sql(value='confidence')} AS confidence")
add("e2_funnel_stage", "SELECT keyword, funnel_stage FROM items", "items")


def query_type_sql(x: str) -> str:
    merged = {k: list(v) for k, v in wl.QUERY_PATTERNS.items()}
    for name, extra in wl.QUERY_LOCALES["data"].items():
        merged.setdefault(name, []).extend(extra)
    cases = []
    for name, patterns in merged.items():
        hit = " OR ".join(f"regexp_matches({x}, {s(re2(p))})" for p in patterns)
        cases.append((f"({hit})", s(name)))
    return case(cases, "'complex_research'")


add(
    "e3_query_type",
    f"SELECT doc_id, sent_no, {query_type_sql('q')} AS query_type FROM (SELECT *, lower(sentence) AS q FROM sent)",
    "sent",
)


def suitability_sql(x: str, low: str) -> str:
    def bump(cond: str, v: float) -> str:
        return f"CASE WHEN {cond} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"

    return (
        "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE "
        f"+ {bump(starts_any(low, lx.QUESTION_WORDS), 0.15)} + {bump(n_words(x) + ' >= 5', 0.1)} "
        f"+ {bump(contains_any(low, ('vs', 'versus', 'compare', 'difference')), 0.15)} "
        f"+ {bump(contains_any(low, ('best', 'top', 'recommended')), 0.1)} "
        f"- {bump(contains_any(low, ('near me', 'in dubai', 'in abu dhabi')), 0.1)} "
        f"- {bump(contains_any(low, ('buy', 'price', 'discount', 'book', 'hire')), 0.15)}))"
    )


add(
    "e4_ai_suitability",
    f"""SELECT doc_id, sent_no, round({suitability_sql('sentence', 'q')}, 9) AS suitability
FROM (SELECT *, lower(sentence) AS q FROM sent)""",
    "sent",
)
FORMAT = case([(contains_any("keyword", p), s(n)) for n, p, _ in lx.CONTENT_FORMATS], "NULL")
kw("e5_content_format", f"coalesce({FORMAT}, '') AS format")


def schema_sql(cluster: str) -> str:
    cases = [(contains_any(cluster, t), s(n)) for n, t in lx.SCHEMA_CLUSTER_TERMS]
    cases += [(f"intent = {s(k)}", s(v)) for k, v in lx.SCHEMA_BY_INTENT.items()]
    return case(cases, "'WebPage'")


add("e6_schema_type", f"SELECT keyword, {schema_sql('parent_topic')} AS schema_type FROM items", "items")
LENGTH = "CASE {c} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in lx.LENGTH_BY_INTENT.items()) + " ELSE '1000-1500 words' END"
TYPE = "CASE {c} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in lx.TYPE_BY_INTENT.items()) + " ELSE 'Blog Post or Article' END"
add(
    "e7_suggest_length_type",
    f"SELECT keyword, {LENGTH.format(c='intent')} AS length, {TYPE.format(c='intent')} AS type FROM items",
    "items",
)


def topic_sql(stop: Iterable[str]) -> str:
    telling = f"list_filter({TOK}, lambda w: length(w) > 2 AND NOT list_contains({arr(stop)}, w))"
    return f"coalesce({telling}[1], array_to_string({TOK}[1:2], ' '))"


kw("e8_topic_fallback", f"{topic_sql(wl.TOPIC_STOPWORDS)} AS topic")
add(
    "e9_parent_topic",
    f"""SELECT keyword, CASE WHEN length(keyword) % 3 = 0 THEN replace({topic_sql(lx.TOPIC_STOPWORDS)}, 'ß', 'ss')
  WHEN length(keyword) % 2 = 0 THEN cluster ELSE split_part(keyword, ' ', 1) END AS parent_topic FROM flagged""",
    "flagged",
)

# --- F ---------------------------------------------------------------------------------------

add("f1_volume_raw", f"SELECT keyword, round({volume_sql(N_DOCS)}, 9) AS volume_raw FROM flagged", "flagged")
RESULTS = "CASE WHEN length(keyword) % 4 = 0 THEN freq * 1000 END"
add(
    "f2_difficulty_raw",
    f"SELECT keyword, round({difficulty_sql(N_DOCS, RESULTS)}, 9) AS difficulty_raw FROM flagged",
    "flagged",
)
add("f3_relative_interest", f"SELECT keyword, round({ranked('kw', 'freq')}, 9) AS relative_interest FROM kw", "kw")
add("f4_difficulty_norm", f"SELECT keyword, round({spread('kw', 'freq')}, 9) AS difficulty FROM kw", "kw")
add(
    "f5_business_relevance",
    f"""SELECT keyword, {RELEVANCE} AS mixed,
  CASE WHEN intent IN ('transactional', 'commercial') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS sales,
  CASE WHEN intent IN ('informational', 'navigational') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS brand FROM items""",
    "items",
)
define("kwi", f"SELECT *, {intent_sql()} AS intent FROM kw", "kw")
add("f6_serp_features", f"SELECT keyword, {joined(features_sql())} AS features FROM kwi", "kwi")
add("f7_ctr_potential", f"SELECT keyword, round({ctr_sql()}, 9) AS ctr_potential FROM kwi", "kwi")
add("f8_commercial_value", f"SELECT keyword, round({commercial_sql()}, 9) AS commercial_value FROM kwi", "kwi")
add(
    "f9_naturalness",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
refs AS (SELECT label, list_cosine_similarity(v.e, v.e) AS one, e FROM v WHERE label IN (0, 1))
SELECT k.vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (
  avg(list_cosine_similarity(k.e, r.e)) FILTER (r.label = 0)
  - avg(list_cosine_similarity(k.e, r.e)) FILTER (r.label = 1) + 1.0::DOUBLE) / 2.0::DOUBLE)), 6) AS naturalness
FROM v k, refs r GROUP BY k.vec_id""",
)
add(
    "f10_universal_penalty",
    "SELECT keyword, round(least(universal * 0.3::DOUBLE, 0.9::DOUBLE), 9) AS penalty FROM unic",
    "unic",
)
add(
    "f11_keyword_metrics",
    f"""SELECT keyword, round(relative_interest, 9) AS relative_interest, round(difficulty, 9) AS difficulty,
  round(ctr_potential, 9) AS ctr_potential, {joined('serp_features')} AS serp_features,
  true AS estimated, validated FROM measured""",
    "measured",
)
add("f12_opportunity", "SELECT keyword, round(opportunity_score, 9) AS opportunity_score FROM items", "items")

# --- G ---------------------------------------------------------------------------------------

define(
    "kwords",
    f"""SELECT keyword, list_filter(string_split({clean('keyword')}, ' '),
    lambda t: length(t) >= 2 AND NOT list_contains({arr(lx.ENGLISH_STOPWORDS)}, t)) AS ws FROM kw""",
    "kw",
)
define("kwtf", "SELECT keyword, word, count(*) AS tf FROM (SELECT keyword, unnest(ws) AS word FROM kwords) GROUP BY ALL", "kwords")
define(
    "kwraw",
    """SELECT keyword, word, tf * (ln((1 + (SELECT count(*) FROM kwords)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS v
  FROM kwtf JOIN (SELECT word, count(*) AS df FROM kwtf GROUP BY word) USING (word)""",
    "kwords", "kwtf",
)
add(
    "g1_vectorize",
    """SELECT keyword, word, round(v / sqrt(sum(v * v) OVER (PARTITION BY keyword)), 6) AS weight FROM kwraw
UNION ALL SELECT keyword, NULL, NULL FROM kwords WHERE len(ws) = 0""",
    "kwraw", "kwords",
)

add("g3_first_word_clusters", "SELECT keyword, split_part(keyword, ' ', 1) AS cluster FROM kw", "kw")


def entity_list(stop: Iterable[str], two: str) -> str:
    keep = arr(stop)
    single = f"list_filter({TOK}, lambda w: length(w) >= 2 AND NOT list_contains({keep}, w))"
    pairs = (
        f"list_filter(list_transform(range(1, greatest(len({TOK}), 1)), lambda i: "
        f"CASE WHEN {two.format(a=f'{TOK}[i]', b=f'{TOK}[i + 1]')} THEN {TOK}[i] || ' ' || {TOK}[i + 1] END), "
        "lambda x: x IS NOT NULL)"
    )
    return single, pairs


_SINGLE, _PAIRS = entity_list(wl.ENTITY_STOPWORDS, f"NOT list_contains({arr(wl.ENTITY_STOPWORDS)}, {{a}}) AND NOT list_contains({arr(wl.ENTITY_STOPWORDS)}, {{b}})")
ENTITIES = f"list_concat({_SINGLE}, {_PAIRS})"
NAME_GRAMS = (
    f"list_concat(list_filter({TOK}, lambda w: length(w) > 2 AND NOT list_contains({arr(wl.NAME_STOPWORDS)}, w)), {grams(TOK, 2)})"
)
Q["g4_cluster_name"] = with_tables(
    f"""SELECT cluster_id, cluster FROM (
WITH g AS (SELECT cluster, keyword, unnest(l) AS gram, unnest(range(len(l))) AS pos FROM (
    SELECT cluster, keyword, {NAME_GRAMS} AS l FROM flagged)),
n AS (SELECT cluster, gram, count(*) AS n, min((keyword, pos)) AS first FROM g GROUP BY ALL),
b AS (SELECT cluster, gram FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS r FROM n) WHERE r = 1),
o AS (SELECT f.cluster, min(f.keyword) AS opened, any_value('cluster-' || coalesce(replace(b.gram, ' ', '-'), 'misc')) AS name
  FROM flagged f LEFT JOIN b ON b.cluster = f.cluster GROUP BY f.cluster)
SELECT cluster AS cluster_id, CASE WHEN opened > min(opened) OVER (PARTITION BY name) THEN name || '-' || cluster ELSE name END AS cluster FROM o)""",
    "flagged",
)
add(
    "g5_pillar",
    """SELECT cluster, keyword AS pillar FROM (SELECT *, row_number() OVER (
  PARTITION BY cluster ORDER BY freq DESC, length(keyword), keyword) AS r FROM flagged) WHERE r = 1""",
    "flagged",
)
add(
    "g6_keyword_entities",
    f"SELECT entity, count(*) AS count FROM (SELECT unnest({ENTITIES}) AS entity FROM kw) GROUP BY entity",
    "kw",
)
define(
    "thin",
    f"""SELECT z.cluster, coalesce(e.entity_count, 0) AS entity_count, z.keyword_count,
    coalesce(e.entity_count, 0) / z.keyword_count AS density, e.mentions / e.entity_count AS mean FROM (
    SELECT cluster, count(*) AS keyword_count FROM flagged GROUP BY cluster) z
  LEFT JOIN (SELECT cluster, count(*) AS entity_count, sum(n)::BIGINT AS mentions FROM (
      SELECT cluster, entity, count(*) AS n FROM (
        SELECT cluster, unnest({ENTITIES}) AS entity FROM flagged) GROUP BY ALL)
    WHERE n >= 2 OR contains(entity, ' ') GROUP BY cluster) e ON e.cluster = z.cluster""",
    "flagged",
)
REASONS = """list_filter([
  CASE WHEN entity_count < 3 THEN 'Low entity diversity: ' || entity_count || ' entities (min: 3)' END,
  CASE WHEN density < 1.2 THEN 'Low entity density: ' || printf('%.2f', density) || ' (min: 1.2)' END,
  CASE WHEN entity_count > 0 AND mean < 1.5 AND keyword_count >= 5 THEN
    'Low entity coherence: entities appear in avg ' || printf('%.1f', mean) || ' keywords' END], lambda x: x IS NOT NULL)"""
add(
    "g7_entity_cooccurrence",
    f"""SELECT cluster, entity_count, keyword_count, printf('%.3f', density)::DOUBLE AS entity_density,
  len({REASONS}) > 0 AS thin_content_risk, {joined(REASONS)} AS risk_reasons FROM thin""",
    "thin",
)
add(
    "g8_cluster_risk_summary",
    f"SELECT cluster, CASE WHEN len({REASONS}) > 0 THEN 'at_risk' ELSE 'healthy' END AS status FROM thin",
    "thin",
)

# --- H ---------------------------------------------------------------------------------------

add("h1_suggest_validate", "SELECT keyword, validated FROM checked", "checked")
add(
    "h1_suggest_validate_top",
    "SELECT c.keyword, c.validated FROM checked c JOIN (SELECT keyword FROM kw ORDER BY freq DESC, keyword LIMIT 100) t "
    "ON t.keyword = c.keyword",
    "checked", "kw",
)
PLAIN = (
    "round(relative_interest, 9) AS relative_interest, round(difficulty, 9) AS difficulty, "
    "round(ctr_potential, 9) AS ctr_potential"
)
add(
    "h2_assemble_items",
    f"""SELECT keyword, cluster,
  CASE WHEN length(keyword) % 3 = 1 THEN replace(cluster, 'ß', 'ss') ELSE cluster END AS parent_topic,
  intent, funnel_stage, {PLAIN},
  {joined('serp_features')} AS serp_features, estimated, validated,
  round(opportunity_score, 9) AS opportunity_score FROM items""",
    "items",
)
RANKING = "opportunity_score DESC, relative_interest DESC, keyword"
add(
    "h3_top_per_cluster",
    f"""SELECT keyword, cluster, round(opportunity_score, 9) AS opportunity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {RANKING}) AS r FROM items) WHERE r <= 4""",
    "items",
)
add("h5_quality_gate", "SELECT keyword, validated FROM items WHERE validated OR opportunity_score >= 0.05", "items")
add(
    "h6_validate_schema",
    """SELECT replace(keyword, 'ß', 'ss') || CASE WHEN length(keyword) % 5 = 0 THEN ' x' ELSE '' END AS keyword,
  CASE WHEN length(keyword) % 7 <> 0 THEN cluster || ' b' ELSE 'unclustered' END AS cluster,
  CASE WHEN length(keyword) % 11 = 0 THEN 'odd' ELSE intent END AS intent, 'TOFU' AS funnel_stage,
  CASE WHEN length(keyword) % 2 = 0 THEN 'a|b' ELSE '' END AS serp_features,
  round(relative_interest * CASE WHEN length(keyword) % 13 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END, 9) AS relative_interest,
  0.5::DOUBLE AS difficulty,
  array_to_string(list_filter([CASE WHEN length(keyword) % 11 = 0 THEN 'intent: not allowed' END,
    CASE WHEN length(keyword) % 13 = 0 AND relative_interest * 3.0::DOUBLE > 1 THEN 'relative_interest: must lie in 0..1' END],
    lambda x: x IS NOT NULL), '|') AS errors FROM items""",
    "items",
)
define("raw7", f"SELECT *, {intent_sql(lx.INTENT_SIGNALS, brands=False)} AS intent, {intent_sql(lx.INTENT_SIGNALS, 'confidence', False)} AS intent_confidence, {volume_sql('0')} AS v, {difficulty_sql('0')} AS d FROM flagged", "flagged")
add(
    "h7_score_candidates",
    f"""SELECT keyword, intent, intent_confidence,
  CASE intent WHEN 'informational' THEN 'TOFU' WHEN 'transactional' THEN 'BOFU' ELSE 'MOFU' END AS funnel_stage,
  round(ri, 9) AS relative_interest, round(di, 9) AS difficulty,
  round(ri * {ctr_sql()} * (1.0::DOUBLE - di)
    * CASE WHEN intent IN ('informational', 'navigational') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END, 9) AS opportunity_score
FROM (SELECT *, {ranked('raw7', 'v')} AS ri, {spread('raw7', 'd')} AS di FROM raw7)""",
    "raw7",
)

# --- I ---------------------------------------------------------------------------------------

define(
    "rank_kw",
    f"SELECT DISTINCT source AS competitor, unnest({grams('t', 2)}) AS keyword FROM dtoks",
    "dtoks",
)
define("rivals", "SELECT DISTINCT keyword FROM rank_kw", "rank_kw")
GAP = "opportunity_score * (1.0::DOUBLE - difficulty)"
add(
    "i1_competitor_gaps",
    f"""SELECT keyword, 'high_opportunity (' || printf('%.2f', opportunity_score) || ')'
  || CASE WHEN difficulty <= 0.5 THEN ', low_difficulty (' || printf('%.2f', difficulty) || ')' ELSE '' END
  || CASE WHEN missing THEN ', competitor_missing' ELSE '' END AS gap_reason,
  round(CASE WHEN missing THEN {GAP} * 1.5::DOUBLE ELSE {GAP} END, 9) AS gap_score
FROM (SELECT i.*, r.keyword IS NULL AS missing FROM items i LEFT JOIN rivals r ON r.keyword = i.keyword)
WHERE opportunity_score >= 0.03 AND (difficulty <= 0.5 OR missing)""",
    "items", "rivals",
)
add(
    "i2_gap_score",
    f"SELECT keyword, round(CASE WHEN NOT validated THEN {GAP} * 1.5::DOUBLE ELSE {GAP} END, 9) AS gap_score FROM items",
    "items",
)
add(
    "i3_competitor_overlap",
    """SELECT competitor, overlap_count, array_to_string(list_sort(shared)[1:50], '|') AS overlap_keywords,
  (SELECT count(*) FROM items) - overlap_count AS unique_to_us_count, unique_to_them_count,
  array_to_string(list_sort(only_them)[1:20], '|') AS unique_to_them_sample,
  round(overlap_count / (SELECT count(*) FROM items) * 100, 9) AS overlap_percentage FROM (
  SELECT competitor, count(i.keyword) AS overlap_count, count(*) - count(i.keyword) AS unique_to_them_count,
    coalesce(list(r.keyword) FILTER (i.keyword IS NOT NULL), []) AS shared,
    coalesce(list(r.keyword) FILTER (i.keyword IS NULL), []) AS only_them
  FROM rank_kw r LEFT JOIN items i ON i.keyword = r.keyword GROUP BY competitor)""",
    "items", "rank_kw",
)
WIN = "opportunity_score * CASE WHEN validated THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"
define(
    "wins",
    f"SELECT keyword, cluster, {WIN} AS score FROM items WHERE difficulty <= 0.3 AND opportunity_score >= 0.2 ORDER BY {WIN} DESC, keyword LIMIT 20",
    "items",
)
add("i4_quick_wins", "SELECT keyword, round(score, 9) AS score FROM wins", "wins")
define(
    "gaps0",
    """SELECT i.keyword FROM items i LEFT JOIN rivals r ON r.keyword = i.keyword
  WHERE opportunity_score >= 0.6 AND (difficulty <= 0.5 OR r.keyword IS NULL)""",
    "items", "rivals",
)
define(
    "wins0",
    f"SELECT cluster FROM items WHERE difficulty <= 0.3 AND opportunity_score >= 0.5 ORDER BY {WIN} DESC, keyword LIMIT 1",
    "items",
)
define("thin_c", "SELECT cluster, count(*) AS keyword_count FROM items GROUP BY cluster HAVING count(*) < 3", "items")
add(
    "i5_gap_report",
    """SELECT (SELECT count(*) FROM items) AS total_keywords, g AS gap_count, array_to_string(list_filter([
  CASE WHEN g > 0 THEN 'Found ' || g || ' gap opportunities where competitors are weak. Prioritize content creation for these keywords.' END,
  CASE WHEN w IS NOT NULL THEN 'Top quick-win cluster: ''' || w || '''. Create pillar content for this topic first.' END,
  CASE WHEN t <> '' THEN 'Thin clusters detected: ' || t || '. Consider merging or expanding these topics.' END],
  lambda x: x IS NOT NULL), '|') AS recommendations
FROM (SELECT (SELECT count(*) FROM gaps0) AS g, (SELECT cluster FROM wins0) AS w,
  (SELECT array_to_string(list_sort(list(cluster))[1:5], ', ') FROM thin_c) AS t)""",
    "items", "gaps0", "wins0", "thin_c",
)
add("i5_thin_clusters", "SELECT cluster, keyword_count FROM thin_c", "thin_c")


def minimum(default: int) -> str:
    return "CASE f " + " ".join(f"WHEN {s(n)} THEN {m}" for n, _, m in lx.CONTENT_FORMATS) + f" ELSE {default} END"


define(
    "gaps1",
    f"""SELECT keyword, gap_type, CASE gap_type WHEN 'missing_topic' THEN 1 WHEN 'thin_content' THEN 2 ELSE 6 END::BIGINT AS priority,
    CASE gap_type WHEN 'missing_topic' THEN 'Create new pillar content'
      WHEN 'competitive_gap' THEN 'Create competing content with differentiation'
      ELSE 'Expand from ' || wc || ' to ' || {minimum(800)} || '+ words' END AS action,
    coalesce(f, '') AS expected_format,
    (CASE WHEN gap_type = 'thin_content' THEN {minimum(800)} ELSE {minimum(1000)} END)::BIGINT AS recommended_word_count,
    CASE WHEN gap_type = 'thin_content' THEN url ELSE '' END AS existing_url,
    CASE WHEN gap_type = 'thin_content' THEN wc ELSE -1 END AS current_word_count FROM (
    SELECT *, CASE WHEN url IS NULL AND rival THEN 'competitive_gap' WHEN url IS NULL THEN 'missing_topic'
      WHEN wc < {minimum(800)} THEN 'thin_content' END AS gap_type FROM (
      SELECT k.keyword, {FORMAT.replace('keyword', 'k.keyword')} AS f, e.url, e.wc, s.suggestion IS NOT NULL AS rival
      FROM kw k LEFT JOIN (
        SELECT low, 'doc/' || max(doc_id) AS url, max_by(n_chars // 5, doc_id) AS wc FROM (
          SELECT doc_id, n_chars, unnest({grams('t', 2)}) AS low FROM dtoks) GROUP BY low) e ON e.low = k.keyword
      LEFT JOIN sug s ON s.suggestion = k.keyword)) WHERE gap_type IS NOT NULL""",
    "kw", "dtoks", "sug",
)
add("i6_content_gaps", "SELECT * FROM gaps1", "gaps1")
ORDERED = "priority, length(keyword) DESC, keyword"
add(
    "i7_content_calendar",
    f"""SELECT i // 3 + 1 AS week, i % 3 + 1 AS slot, keyword, gap_type, expected_format AS format,
  recommended_word_count AS target_word_count FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDERED}) - 1 AS i FROM gaps1) WHERE i < 60""",
    "gaps1",
)
add(
    "i8_gaps_by_cluster",
    """SELECT g.keyword, coalesce(f.cluster, 'unclustered') AS cluster FROM gaps1 g
LEFT JOIN (SELECT keyword, cluster FROM flagged WHERE length(keyword) % 2 = 0) f ON f.keyword = g.keyword""",
    "gaps1", "flagged",
)
add(
    "i9_location_gaps",
    """SELECT keyword AS base_keyword, location, keyword || ' ' || location AS keyword_variant, 5::BIGINT AS priority
FROM kw, (SELECT unnest(['anea', 'que']) AS location)
WHERE NOT (contains(keyword, 'anea') OR contains(keyword, 'erst') OR contains(keyword, 'que'))""",
    "kw",
)
add(
    "i10_prioritize_leads",
    f"""SELECT keyword, gap_type, CASE WHEN w > 0.7 THEN greatest(1, priority - 2) WHEN w > 0.4 THEN greatest(1, priority - 1)
  ELSE priority END AS priority, CASE WHEN w > 0.7 THEN 'high' WHEN w > 0.4 THEN 'medium' ELSE 'low' END AS commercial_value
FROM (SELECT *, {commercial_sql("'commercial'", True, False)} AS w FROM gaps1)""",
    "gaps1",
)

# --- J ---------------------------------------------------------------------------------------

FIELDS = ("key", "display", "region", "type")


def hit(kind: str, text: str, token: bool) -> str:
    rows = [g for g in wl.GAZETTEER if g[0] == kind]
    pairs = []
    for n, (_, key, *_rest) in enumerate(rows, 1):
        cond = f"contains(' ' || {text} || ' ', {s(' ' + key + ' ')})" if token else f"contains({text}, {s(key)})"
        pairs.append((cond, str(n)))
    return case(pairs, "0")


KINDS = ("alias", "emirate", "district", "landmark", "free_zone", "government", "certification", "legal", "construction")


def look(kind: str, field: str) -> str:
    rows = [g for g in wl.GAZETTEER if g[0] == kind]
    at = {"display": 2, "region": 3, "type": 4}[field]
    body = " ".join(f"WHEN {n} THEN {s(r[at]) if r[at] else 'NULL'}" for n, r in enumerate(rows, 1))
    return f"CASE i_{kind} {body} END"


def tagged(source: str, token: bool = False, columns: str = "*") -> str:
    idx = ", ".join(f"{hit(k, 'keyword', token)} AS i_{k}" for k in KINDS)
    region = ", ".join(look(k, "region") for k in KINDS if k != "construction")
    local = " OR ".join(f"i_{k} > 0" for k in ("alias", "emirate", "district", "landmark", "free_zone", "government", "legal"))
    work = " OR ".join(f"i_{k} > 0" for k in ("government", "certification", "legal", "construction"))
    return f"""SELECT {columns}, coalesce({region}) AS emirate, {look('district', 'display')} AS district,
  {look('landmark', 'display')} AS landmark, {look('free_zone', 'display')} AS free_zone,
  {look('government', 'display')} AS government_entity, {look('certification', 'display')} AS certification,
  {look('legal', 'display')} AS legal_term, {look('construction', 'display')} AS construction_term,
  CASE WHEN i_free_zone > 0 THEN {look('free_zone', 'type')} ELSE {look('district', 'type')} END AS location_type,
  ({local}) AS is_local, ({work}) AS is_contracting FROM (SELECT *, {idx} FROM {source})"""


define("tags", tagged("kw"), "kw")
ENTITY_COLUMNS = (
    "emirate", "district", "landmark", "free_zone", "government_entity", "certification",
    "legal_term", "construction_term", "location_type",
)
FILLED = ", ".join(f"coalesce({c}, '') AS {c}" for c in ENTITY_COLUMNS)
add("j1_extract_entities", f"SELECT keyword, {FILLED}, is_local, is_contracting FROM tags", "tags")
add(
    "j1_gazetteer_matches",
    f"""SELECT keyword, kind, 'the ' || key AS display, region, 'phrase' AS type FROM (
  SELECT *, row_number() OVER (PARTITION BY keyword, kind ORDER BY length(key) DESC, key) AS r FROM (
    SELECT g.keyword, z.kind, z.key, z.region FROM (
      SELECT DISTINCT keyword, unnest(list_concat({TOK}, list_concat({grams(TOK, 2)}, {grams(TOK, 3)}))) AS key FROM kw) g
    JOIN (SELECT CASE WHEN length(keyword) % 2 = 0 THEN 'district' ELSE 'landmark' END AS kind, keyword AS key, n_name AS region
      FROM kw JOIN nation ON n_nationkey = length(keyword) % 25 ) z ON z.key = g.key)) WHERE r = 1""",
    "kw",
)
ENDINGS = [e for k, _ in wl.REGIONS for e in (k, f"in {k}")] + [
    g[1] for g in wl.GAZETTEER if g[0] == "district" and g[3] == "Region B"
]
add(
    "j2_location_variations",
    f"""SELECT keyword, unnest(range(len(l))) AS position, unnest(l) AS variation FROM (
  SELECT keyword, list_concat([keyword], list_transform({arr(ENDINGS)}, lambda e: keyword || ' ' || e)) AS l FROM kw)""",
    "kw",
)
define("tags_token", tagged("kw", True), "kw")
add("j3_enrich_entities", f"SELECT keyword, freq, {FILLED}, is_local, is_contracting FROM tags_token", "tags_token")
add(
    "j4_entity_clusters",
    "SELECT CASE WHEN is_local THEN coalesce(district, emirate, 'UAE') ELSE 'global' END AS location, keyword FROM tags",
    "tags",
)

# --- K ---------------------------------------------------------------------------------------

add(
    "k1_term_translate",
    f"""SELECT word, arabic, {case([(f"arabic = {s(ar)}", s(en)) for en, ar, _ in wl.TERMS], 'NULL')} AS english, count(*) AS n FROM (
  SELECT word, {case([(f"lower(word) = {s(en)}", s(ar)) for en, ar, _ in wl.TERMS], 'NULL')} AS arabic FROM (
    SELECT unnest({words('sentence')}) AS word FROM sent)) WHERE arabic IS NOT NULL GROUP BY word, arabic""",
    "sent",
)


def swap(text: str, old: str, new: str) -> str:
    # whole words between single spaces, so the fence is a space or an end
    return f"trim(replace(replace(' ' || replace({text}, ' ', '  ') || ' ', {s(' ' + old.replace(' ', '  ') + ' ')}, {s(' ' + new.replace(' ', '  ') + ' ')}), '  ', ' '))"


def has_word(text: str, term: str) -> str:
    return f"contains(' ' || {text} || ' ', {s(' ' + term + ' ')})"


TERM_CASES = case(
    [
        (
            f"contains(keyword, {s(en)})",
            "[" + ", ".join(f"replace(keyword, {s(en)}, {s(v)})" for v in (ar, *dialect)) + "]",
        )
        for en, ar, dialect in wl.TERMS
    ],
    "[]::VARCHAR[]",
)
PLACE_CASES = ", ".join(
    f"CASE WHEN {has_word('keyword', en)} THEN {swap('keyword', en, ar)} END" for en, ar in wl.LOCATIONS
)
define(
    "variants",
    f"""SELECT DISTINCT keyword, unnest(list_concat([keyword], list_concat({TERM_CASES},
    list_filter([{PLACE_CASES}], lambda x: x IS NOT NULL)))) AS text FROM kw""",
    "kw",
)
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"
add(
    "k2_detect_arabic",
    f"SELECT text, regexp_matches(text, '{ARABIC}') AS arabic, regexp_matches(text, '[37529]') AS arabizi FROM variants",
    "variants",
)
add("k2_detect_arabizi", "SELECT doc_id, sent_no, regexp_matches(sentence, '[37529]') AS arabizi FROM sent", "sent")
add("k3_expand_bilingual", "SELECT keyword, text FROM variants", "variants")
ARABIC_INTENT = case([(contains_any("text", t), s(n)) for n, t in lx.ARABIC_INTENTS], "NULL")
add("k4_arabic_intent", f"SELECT text, coalesce({ARABIC_INTENT}, '') AS intent FROM variants", "variants")


def normal(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x{{064B}}-\x{{0652}}\x{{0670}}]', '', 'g')"
    x = rf"regexp_replace({x}, 'ة({NON_WORD}|$)', 'ه\1', 'g')"
    x = f"regexp_replace({x}, '[إأآا]', 'ا', 'g')"
    return rf"regexp_replace({x}, 'ى({NON_WORD}|$)', 'ي\1', 'g')"


add(
    "k5_normalize_arabic",
    f"SELECT text, {normal('''replace(replace(text, 'ق', 'قّ'), 'ال', 'أل')''')} AS normal FROM variants",
    "variants",
)
FIRST_TERM = case([(f"contains(keyword, {s(en)})", str(n)) for n, (en, _, _) in enumerate(wl.TERMS, 1)], "0")
FIRST_ARABIC = "CASE i " + " ".join(
    f"WHEN {n} THEN replace(keyword, {s(en)}, {s(ar)})" for n, (en, ar, _) in enumerate(wl.TERMS, 1)
) + " END"
FIRST_DIALECT = "CASE i " + " ".join(
    f"WHEN {n} THEN {s('|'.join(d))}" for n, (_, _, d) in enumerate(wl.TERMS, 1)
) + " ELSE '' END"
_known = dict(wl.LOCATIONS)
PLACES6 = " UNION ALL ".join(
    f"SELECT {n}::BIGINT AS position, keyword || {s(' ' + p)} AS english, "
    + (f"coalesce(ar, keyword) || {s(' ' + _known[p])}" if p in _known else "''")
    + " AS arabic, '' AS dialects, true AS is_location, i > 0 AS is_construction FROM b"
    for n, p in enumerate(wl.KEY_LOCATIONS, 1)
)
add(
    "k6_bilingual_keywords",
    f"""SELECT * FROM (WITH b AS (SELECT *, {FIRST_ARABIC} AS ar FROM (SELECT keyword, {FIRST_TERM} AS i FROM kw))
SELECT 0::BIGINT AS position, keyword AS english, coalesce(ar, '') AS arabic, {FIRST_DIALECT} AS dialects,
  false AS is_location, i > 0 AS is_construction FROM b UNION ALL {PLACES6})""",
    "kw",
)


def pairs_sql(conds: Iterable[tuple[str, str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {s(en + '=' + ar)} END" for c, en, ar in conds) + "], lambda x: x IS NOT NULL)"


def py_normal(word: str) -> str:
    """A dictionary word after normalisation (final letters and alef forms)."""
    out = "".join("ا" if c in "إأآا" else c for c in word)
    return " ".join(
        w[:-1] + {"ة": "ه", "ى": "ي"}.get(w[-1], w[-1]) for w in out.split(" ")
    )


AR_HITS = [(f"contains(nt, {s(py_normal(ar))})", en, ar) for en, ar, _ in wl.TERMS]
EN_HITS = [(f"contains(text, {s(en)})", en, ar) for en, ar, _ in wl.TERMS]
PL_HITS = [(has_word("rt", en), en, ar) for en, ar in wl.LOCATIONS]
add(
    "k7_bilingual_query",
    f"""SELECT text, CASE WHEN a THEN 'arabic' ELSE 'english' END AS primary_language,
  NOT a AND regexp_matches(text, '[37529]') AS is_arabizi,
  CASE WHEN a THEN coalesce({ARABIC_INTENT}, '') ELSE '' END AS arabic_intent,
  coalesce(CASE WHEN a THEN {case([(c, f"replace(text, {s(ar)}, {s(en)})") for c, en, ar in AR_HITS], 'NULL')} END, '') AS english_equivalent,
  coalesce(CASE WHEN NOT a THEN {case([(c, f"replace(text, {s(en)}, {s(ar)})") for c, en, ar in EN_HITS], 'NULL')} END, '') AS arabic_equivalent,
  CASE WHEN a THEN {joined(pairs_sql(AR_HITS))} ELSE {joined(pairs_sql(EN_HITS))} END AS terms,
  CASE WHEN a THEN '' ELSE {joined(pairs_sql(PL_HITS))} END AS places
FROM (SELECT text, regexp_matches(text, '{ARABIC}') AS a, {normal('text')} AS nt,
  regexp_replace(text, '{NON_WORD}+', ' ', 'g') AS rt FROM variants)""",
    "variants",
)

add(
    "m5_keyword_batches",
    """SELECT batch_id, count(*) AS n, min(keyword) AS first, max(keyword) AS last
FROM (SELECT keyword, (row_number() OVER (ORDER BY keyword) - 1) // 50 AS batch_id FROM kw) GROUP BY batch_id""",
    "kw",
)

# --- L ---------------------------------------------------------------------------------------

STOPPED2 = f"list_filter(t, lambda w: NOT list_contains({arr(lx.ENGLISH_STOPWORDS)}, w))"
add(
    "l1_information_gain",
    f"""SELECT * FROM (WITH p AS (SELECT source, doc_id, doc_id = min(doc_id) OVER (PARTITION BY source) AS mine, {STOPPED2} AS t FROM dtoks),
w AS (SELECT source, mine, flatten(list(t ORDER BY doc_id)) AS t FROM p GROUP BY source, mine),
g AS (SELECT source, mine, unnest(t) AS term FROM w UNION ALL SELECT source, mine, unnest({grams('t', 2)}) FROM w
  UNION ALL SELECT source, mine, unnest({grams('t', 3)}) FROM w),
c AS (SELECT source, term, count(*) FILTER (mine) AS a, count(*) FILTER (NOT mine) AS b FROM g GROUP BY ALL),
k AS (SELECT source, term, a * w AS m, b * w AS t FROM (
  SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1.0::DOUBLE END AS w,
    row_number() OVER (PARTITION BY source ORDER BY a + b DESC, term) AS r FROM c) WHERE r <= 500),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m DESC, term) AS rm,
  row_number() OVER (PARTITION BY source ORDER BY t DESC, term) AS rt FROM k),
f AS (SELECT source, term, m, t, rm <= 20 AND m > 0 AS im, rt <= 20 AND t > 0 AS it FROM r),
z AS (SELECT source, count(*) FILTER (im AND NOT it) AS u, count(*) FILTER (im AND it) AS c, count(*) FILTER (NOT im AND it) AS x,
  coalesce(list_sort(list(term) FILTER (im AND NOT it)), []) AS ul, coalesce(list_sort(list(term) FILTER (im AND it)), []) AS cl,
  coalesce(list_sort(list(term) FILTER (NOT im AND it)), []) AS xl,
  CASE WHEN sum(m * m) > 0 AND sum(t * t) > 0 THEN sum(m * t) / sqrt(sum(m * m) * sum(t * t)) ELSE 0.0::DOUBLE END AS sim
  FROM f GROUP BY source)
SELECT source AS comparison_id, printf('%.3f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * (1.0::DOUBLE - sim)
  + 0.4::DOUBLE * (u / greatest(u + c, 1)) + 0.2::DOUBLE * (c / greatest(c + x, 1)))))::DOUBLE AS score,
  array_to_string(ul[1:10], '|') AS unique_concepts, array_to_string(cl[1:10], '|') AS common_concepts,
  array_to_string(xl[1:10], '|') AS missing_concepts,
  array_to_string(list_filter([CASE WHEN x > 5 THEN 'Consider covering these topics: ' || array_to_string(xl[1:5], ', ') END,
    CASE WHEN u < 3 THEN 'Add more unique insights, data, or perspectives' END,
    CASE WHEN sim > 0.7 THEN 'Content is very similar to competitors - differentiate more' END], lambda v: v IS NOT NULL), '|') AS recommendations
FROM z)""",
    "dtoks",
)


def trust_sql() -> str:
    merged = {k: list(v) for k, v in lx.TRUST_PATTERNS.items()}
    for category, extra in wl.TRUST_LOCALES["data"].items():
        merged[category] = merged[category] + list(extra)
    lists = {
        c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, {s(re2(p))}) THEN {s(d)} END" for p, d in rules) + "], lambda x: x IS NOT NULL)"
        for c, rules in merged.items()
    }
    described = list(dict.fromkeys(d for rules in merged.values() for _, d in rules))
    cols = ", ".join(f"{expr} AS l_{c}" for c, expr in lists.items())
    score = {c: f"least(len(l_{c}) / {m}.0::DOUBLE, 1.0::DOUBLE)" for c, m in lx.TRUST_MAXIMUM.items()}
    overall = "0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * {score[c]}" for c, w in lx.TRUST_WEIGHT.items())
    found = "list_concat(l_experience, list_concat(l_expertise, list_concat(l_authority, l_trust)))"
    advice = ", ".join(f"CASE WHEN {score[c]} < 0.4 THEN {s(t)} END" for c, t in lx.TRUST_ADVICE.items())
    each = ", ".join(f"round({score[c]}, 3) AS {c}_score" for c in score)
    return f"""SELECT doc_id, round({overall}, 3) AS overall_score, {each}, {joined(found)} AS signals_found,
  {joined(f"list_filter({arr(described)}, lambda d: NOT list_contains({found}, d))[1:10]")} AS signals_missing,
  {joined(f"list_filter([{advice}], lambda x: x IS NOT NULL)")} AS recommendations
FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, lower(text) AS q FROM documents))"""


add("l2_trust_signals", trust_sql())
add(
    "l7_snippet",
    f"""SELECT doc_id, sent_no, CASE sent_no % 5
  WHEN 0 THEN ti || '? ' || coalesce(p[1], '')
  WHEN 1 THEN array_to_string(list_concat(['**' || ti || '**' || chr(10)], list_transform(p[1:10], lambda x, i: i || '. ' || x)), chr(10))
  WHEN 2 THEN array_to_string(list_concat(['## ' || ti || chr(10)], list_transform(p, lambda x, i: '**Step ' || i || ':** ' || x)), chr(10) || chr(10))
  WHEN 3 THEN array_to_string(list_concat(['## ' || ti || chr(10)], list_transform(p, lambda x: '- ' || x)), chr(10))
  ELSE ti || ' involves the following key considerations:' || chr(10) || chr(10) || array_to_string(list_transform(p, lambda x: '• ' || x), chr(10))
  END AS snippet FROM (SELECT doc_id, sent_no, {title('sentence')} AS ti, {words('sentence')} AS p FROM sent)""",
    "sent",
)


def excerpt(x: str, n: int) -> str:
    return f"""(SELECT CASE WHEN length(st) <= {n} THEN st WHEN dot - 1 > {n} * 0.6 THEN substring(hd, 1, dot)
  ELSE CASE WHEN gap > 0 THEN substring(hd, 1, gap - 1) ELSE hd END || '...' END FROM (
  SELECT *, CASE WHEN contains(hd, '.') THEN length(hd) - instr(reverse(hd), '.') + 1 ELSE 0 END AS dot,
    CASE WHEN contains(hd, ' ') THEN length(hd) - instr(reverse(hd), ' ') + 1 ELSE 0 END AS gap FROM (
    SELECT st, substring(st, 1, {n}) AS hd FROM (SELECT CASE WHEN regexp_matches(tx, '^\\p{{Lu}}') THEN tx
      ELSE upper(substring(tx, 1, 1)) || lower(substring(tx, 2)) END AS st FROM (SELECT {strip(x)} AS tx)))))"""


add(
    "l8_citation_excerpt",
    f"""SELECT doc_id, {excerpt('text', 300)} AS excerpt, {excerpt("('«' || text)", 80)} AS short FROM documents""",
)
add(
    "l3_faq_jsonld",
    """SELECT conv_id, '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || string_agg(
    '{"@type":"Question","name":' || to_json(q.text) || ',"acceptedAnswer":{"@type":"Answer","text":' || to_json(a.text) || '}}',
    ',' ORDER BY q.turn, q.text, a.text) || ']}' AS json_ld
  FROM conversations q JOIN conversations a USING (conv_id)
  WHERE q.role = 'user' AND a.role = 'assistant' AND a.turn = q.turn + 1 GROUP BY conv_id""",
)
add(
    "l4_howto_jsonld",
    """SELECT doc_id, '{"@context":"https://schema.org","@type":"HowTo"' || coalesce(',"name":' || to_json(first), '') || ',"step":['
    || coalesce(steps, '') || ']' || ',"description":' || to_json(lang) || '}' AS json_ld
  FROM documents LEFT JOIN (SELECT doc_id, arg_min(sentence, sent_no) AS first, string_agg(
    '{"@type":"HowToStep","position":' || (sent_no + 1) || ',"text":' || to_json(sentence) || '}', ',' ORDER BY sent_no) AS steps
    FROM sent GROUP BY doc_id) USING (doc_id)""",
    "sent",
)
add("a2_scan_url_list", "SELECT trim(url) AS url, trim(url) AS title, '' AS text FROM pages WHERE trim(url) <> ''")
add("a10_read_keyword_json", "SELECT keyword, keyword[1] AS cluster FROM kw WHERE keyword[1] = 't'", "kw")
for _name in ("a11_write_keywords", "a12_write_run"):
    add(_name, "SELECT keyword, split_part(keyword, ' ', 1) AS cluster FROM kw", "kw")
add(
    "l5_business_jsonld",
    """SELECT s_suppkey, '{"@context":"https://schema.org","@type":"HomeAndConstructionBusiness","name":' || to_json(s_name)
  || ',"address":{"@type":"PostalAddress","streetAddress":"Street 1","addressLocality":' || to_json(n_name) || ',"addressCountry":"AE"}'
  || ',"url":"s/' || s_suppkey || '"'
  || CASE WHEN s_suppkey % 3 > 0 THEN ',"aggregateRating":{"@type":"AggregateRating","ratingValue":4.5,"reviewCount":'
    || (s_suppkey % 3) || ',"bestRating":5}' ELSE '' END
  || ',"hasOfferCatalog":{"@type":"OfferCatalog","name":"Services","itemListElement":[{"@type":"Offer","itemOffered":{"@type":"Service","name":'
  || to_json(n_name) || '}}]}}' AS json_ld FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
add(
    "l6_service_jsonld",
    """SELECT p_partkey, '<script type="application/ld+json">' || chr(10)
  || '{"@context":"https://schema.org","@type":"Service","name":' || to_json(p_name)
  || ',"provider":{"@type":"Organization","name":' || to_json(p_brand) || '},"areaServed":[{"@type":"City","name":' || to_json(p_type)
  || '}],"offers":{"@type":"Offer","priceSpecification":{"@type":"PriceSpecification","price":' || p_size
  || ',"priceCurrency":"AED","minPrice":' || p_size || '}}}' || chr(10) || '</script>' AS html FROM part""",
)

# --- M ---------------------------------------------------------------------------------------

add(
    "m1_parse_expansion",
    f"""SELECT batch_id, keyword, position FROM (
  SELECT batch_id, keyword, row_number() OVER (PARTITION BY batch_id ORDER BY min(line_no)) AS position
  FROM ({LINES}) WHERE role = 'assistant' AND {n_words('keyword')} >= 2 GROUP BY batch_id, keyword) WHERE position <= 5""",
)
TOLD = "length(keyword) % 5 <> 0"
kw(
    "m2_parse_intents",
    f"""CASE WHEN {TOLD} THEN CASE length(keyword) % 7 WHEN 0 THEN 'local' WHEN 1 THEN 'direct_answer'
  WHEN 2 THEN 'transactional' WHEN 4 THEN 'comparative' ELSE 'informational' END ELSE 'informational' END AS intent""",
)
VERDICT = f"NOT ({TOLD} AND length(keyword) % 7 IN (1, 3))"
kw("m3_parse_verdicts", f"{VERDICT} AS valid")
add("m3_verify_filter", f"SELECT keyword, freq FROM kw WHERE {VERDICT}", "kw")
kw(
    "m4_parse_topics",
    f"""CASE WHEN {TOLD} AND length(keyword) % 3 = 0 THEN 'topic ' || trim(replace(substring(keyword, 1, 3), 'ß', 'ss'))
  ELSE {topic_sql(lx.TOPIC_STOPWORDS)} END AS topic""",
)

# --- N ---------------------------------------------------------------------------------------

NW = "len(t)"
add(
    "n1_qa_length",
    f"""SELECT doc_id, sent_no, CASE WHEN n < 3 THEN 'Too few words: ' || n || ' < 3'
  WHEN n > 12 THEN 'Too many words: ' || n || ' > 12' ELSE '' END AS reason
FROM (SELECT *, {n_words('sentence')} AS n FROM sent)""",
    "sent",
)


def score_reason(o: str, i: str) -> str:
    return (
        f"CASE WHEN opportunity_score < {o} THEN 'Low opportunity: ' || printf('%.2f', opportunity_score) || ' < {o}' "
        f"WHEN relative_interest < {i} THEN 'Low relative interest: ' || printf('%.2f', relative_interest) || ' < {i}' END"
    )


add("n2_qa_scores", f"SELECT keyword, coalesce({score_reason('0.02', '0.4')}, '') AS reason FROM items", "items")
add(
    "n3_qa_cluster_size",
    "SELECT cluster, count(*) AS keyword_count, count(*) >= 5 AS kept FROM items GROUP BY cluster",
    "items",
)
define(
    "judged",
    f"""SELECT j.*, z.size, CASE WHEN lr IS NOT NULL THEN 'length' WHEN sr IS NOT NULL THEN 'score' WHEN size < 5 THEN 'cluster' END AS stage FROM (
    SELECT *, CASE WHEN len({TOK}) > 2 THEN 'Too many words: ' || len({TOK}) || ' > 2' END AS lr, {score_reason('0.01', '0.1')} AS sr FROM items) j
  LEFT JOIN (SELECT cluster, count(*) AS size FROM (
    SELECT *, CASE WHEN len({TOK}) > 2 THEN 'x' END AS lr, {score_reason('0.01', '0.1')} AS sr FROM items)
    WHERE lr IS NULL AND sr IS NULL GROUP BY cluster) z ON z.cluster = j.cluster""",
    "items",
)
add(
    "n4_qa_validate",
    """SELECT keyword, coalesce(stage, '') AS rejected_by, coalesce(lr, sr,
  CASE WHEN size < 5 THEN 'Cluster too small: ' || size || ' < 5' END, '') AS reason FROM judged""",
    "judged",
)
define(
    "qa",
    """SELECT count(*) AS original_count, count(*) - count(stage) AS final_count, count(stage) AS removed_count,
    count(stage) / count(*) AS removal_rate, count(*) FILTER (stage = 'length') AS length_rejected,
    count(*) FILTER (stage = 'score') AS score_rejected, count(*) FILTER (stage = 'cluster') AS cluster_rejected,
    count(DISTINCT cluster) FILTER (stage = 'cluster') AS clusters_removed FROM judged""",
    "judged",
)
add("n4_qa_report", "SELECT * REPLACE (round(removal_rate, 9) AS removal_rate) FROM qa", "qa")
BAR = "=" * 60
add(
    "n4_qa_text",
    f"""SELECT array_to_string(['{BAR}', 'QA VALIDATION REPORT', '{BAR}', '',
  'Original keywords:  ' || original_count, 'Final keywords:     ' || final_count,
  'Removed:            ' || removed_count || ' (' || printf('%.1f', removal_rate * 100) || '%)', '', 'Rejection breakdown:',
  '  - Length violations: ' || length_rejected, '  - Score thresholds:  ' || score_rejected,
  '  - Small clusters:    ' || cluster_rejected || ' (' || clusters_removed || ' clusters)', '', 'Validation rules applied:',
  '  - min_cluster_size: 5', '  - max_word_count: 2', '', '{BAR}'], chr(10)) AS report FROM qa""",
    "qa",
)

# --- O ---------------------------------------------------------------------------------------

add(
    "o1_executive_summary",
    """SELECT count(*) AS total_keywords, count(DISTINCT cluster) AS unique_clusters,
  printf('%.2f', (sum((relative_interest)::DECIMAL(28,12))::DOUBLE / count(*))) AS avg_relative_interest, printf('%.2f', (sum((difficulty)::DECIMAL(28,12))::DOUBLE / count(*))) AS avg_difficulty,
  printf('%.2f', (sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*))) AS avg_opportunity, count(*) FILTER (opportunity_score >= 0.5) AS high_priority FROM items""",
    "items",
)
add(
    "o2_intent_distribution",
    f"""SELECT {title('intent')} AS intent, n AS keywords, printf('%.1f', n / (SELECT count(*) FROM items) * 100) || '%' AS share
FROM (SELECT intent, count(*) AS n FROM items GROUP BY intent)""",
    "items",
)
add(
    "o3_top_clusters",
    """SELECT cluster, printf('%.3f', m) AS avg_opportunity FROM (
  SELECT cluster, (sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*)) AS m FROM items GROUP BY cluster ORDER BY round(m, 9) DESC, cluster LIMIT 5)""",
    "items",
)
add(
    "o4_site_architecture",
    f"""SELECT parent_topic, '' AS cluster, 0::BIGINT AS position, 'L1 - Pillar' AS level, {title('parent_topic')} AS name, '' AS intent,
  printf('%.2f', (sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*))) AS opportunity FROM items GROUP BY parent_topic
UNION ALL SELECT parent_topic, cluster, 0, 'L2 - Cluster', cluster, '', printf('%.2f', (sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*))) FROM items GROUP BY parent_topic, cluster
UNION ALL SELECT parent_topic, cluster, r, 'L3 - Keyword', keyword, intent, printf('%.2f', opportunity_score) FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_topic, cluster ORDER BY {RANKING}) AS r FROM items) WHERE r <= 5""",
    "items",
)


def r3(x: str) -> str:
    return f"printf('%.3f', {x})::DOUBLE"


add(
    "o5_cluster_analysis",
    f"""SELECT cluster, count(*) AS count, {r3('sum(relative_interest::DECIMAL(28,12))::DOUBLE')} AS total_interest, {r3('(sum((relative_interest)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_interest,
  {r3('(sum((difficulty)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_difficulty, {r3('(sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_opportunity FROM items GROUP BY cluster""",
    "items",
)
add(
    "o6_intent_analysis",
    f"""SELECT intent, count(*) AS count, {r3('(sum((relative_interest)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_interest, {r3('(sum((difficulty)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_difficulty,
  {r3('(sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_opportunity FROM items GROUP BY intent""",
    "items",
)
# output aliases must not shadow the filter columns
Q["o7_priority_matrix"] = with_tables(
    """SELECT keyword, round(o, 9) AS opportunity_score, round(d, 9) AS difficulty FROM (
  SELECT keyword, opportunity_score AS o, difficulty AS d FROM items
  WHERE opportunity_score >= 0.03 AND difficulty <= 0.7 ORDER BY opportunity_score DESC, keyword LIMIT 50)""",
    "items",
)
Q["h4_global_ranking"] = with_tables(
    f"""SELECT keyword, round(o, 9) AS opportunity_score FROM (
  SELECT keyword, opportunity_score AS o FROM items ORDER BY {RANKING} LIMIT 500)""",
    "items",
)
add(
    "o8_geo_columns",
    f"SELECT keyword, cluster, round({suitability_sql('keyword', 'keyword')}, 9) AS geo_suitability FROM items",
    "items",
)
define("item_tags", tagged("items"), "items")
add(
    "o9_location_analysis",
    f"""SELECT emirate, count(*) AS total_keywords, count(*) FILTER (is_local) AS local_keywords,
  count(*) FILTER (is_contracting) AS contracting_keywords, {r3('(sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*))')} AS avg_opportunity
FROM item_tags WHERE emirate IS NOT NULL GROUP BY emirate""",
    "item_tags",
)
add(
    "o10_recommendations",
    """SELECT 1::BIGINT AS position, 'HIGH' AS priority, 'Quick Wins' AS category,
  'Prioritize ' || n || ' high-opportunity keywords (score ≥ 0.2)' AS recommendation,
  'Create or optimize content for these keywords first' AS action
FROM (SELECT count(*) FILTER (opportunity_score >= 0.2) AS n FROM items) WHERE n > 0
UNION ALL SELECT 2, 'HIGH', 'Content Strategy', 'Focus content efforts on ''' || cluster || ''' cluster',
  'Develop comprehensive pillar content for this topic' FROM (
  SELECT cluster FROM items GROUP BY cluster ORDER BY round((sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*)), 9) DESC, cluster LIMIT 1)
UNION ALL SELECT 3, 'MEDIUM', 'Content Format', 'Most keywords are ' || intent || ' intent (' || n || ' keywords)',
  'Optimize content format for ' || intent || ' search intent' FROM (
  SELECT intent, count(*) AS n FROM items GROUP BY intent ORDER BY n DESC, intent LIMIT 1)
UNION ALL SELECT 4, 'MEDIUM', 'Localization', 'Target Abu Dhabi-specific terms',
  'Include TAMM, Estidama, and local district names in content'""",
    "items",
)
SUFFIX = " | Brand Abu Dhabi"
add(
    "o11_seo_metadata",
    f"""SELECT cluster, CASE WHEN length(base) + {len(SUFFIX)} <= 60 THEN base || '{SUFFIX}'
    ELSE substring(base, 1, {60 - len(SUFFIX) - 3}) || '...' || '{SUFFIX}' END AS title,
  CASE WHEN length(full_text) > 160 THEN substring(full_text, 1, 157) || '...' ELSE full_text END AS description,
  primary_keyword, array_to_string(sec, '|') AS secondary_keywords, topic AS parent_topic, intent,
  {schema_sql('cluster')} AS suggested_schema, ttopic || ' - ' || tprimary AS h1_suggestion, n AS keywords_count,
  round(m, 9) AS avg_opportunity FROM (
  SELECT *, 'Best ' || tprimary AS base, 'Expert ' || ttopic || ' services in Abu Dhabi.'
    || CASE WHEN len(sec) > 0 THEN ' We offer: ' || array_to_string(list_transform(sec, lambda k: {title('k')}), ', ') || '.' ELSE '' END
    || ' Contact us for a free quote!' AS full_text FROM (
    SELECT *, {title('primary_keyword')} AS tprimary, {title('topic')} AS ttopic FROM (
      SELECT cluster, max(keyword) FILTER (r = 1) AS primary_keyword, max(parent_topic) FILTER (r = 1) AS topic,
        max(intent) FILTER (r = 1) AS intent, coalesce(list(keyword ORDER BY r) FILTER (r BETWEEN 2 AND 4), []) AS sec,
        count(*) AS n, (sum((opportunity_score)::DECIMAL(28,12))::DOUBLE / count(*)) AS m FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY opportunity_score DESC, keyword) AS r FROM items)
      GROUP BY cluster)))""",
    "items",
)
define(
    "parts",
    f"""SELECT z.*, i.intent AS primary_intent, f.funnel_stage AS funnel, coalesce(q.questions, []) AS questions FROM (
    SELECT cluster, count(*) AS n, (sum((relative_interest)::DECIMAL(28,12))::DOUBLE / count(*)) AS interest, (sum((difficulty)::DECIMAL(28,12))::DOUBLE / count(*)) AS difficulty, (sum((ctr_potential)::DECIMAL(28,12))::DOUBLE / count(*)) AS ctr,
      list(keyword ORDER BY r) FILTER (r <= 10) AS targets FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY opportunity_score DESC, keyword) AS r FROM items) GROUP BY cluster) z
  JOIN (SELECT cluster, intent FROM (SELECT cluster, intent, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, intent) AS r
    FROM items GROUP BY cluster, intent) WHERE r = 1) i ON i.cluster = z.cluster
  JOIN (SELECT cluster, funnel_stage FROM (SELECT cluster, funnel_stage, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, funnel_stage) AS r
    FROM items GROUP BY cluster, funnel_stage) WHERE r = 1) f ON f.cluster = z.cluster
  LEFT JOIN (SELECT cluster, list(keyword ORDER BY r) AS questions FROM (
    SELECT cluster, keyword, row_number() OVER (PARTITION BY cluster ORDER BY opportunity_score DESC, keyword) AS r
    FROM items WHERE {starts_any('keyword', lx.QUESTION_WORDS)}) WHERE r <= 8 GROUP BY cluster) q ON q.cluster = z.cluster""",
    "items",
)
NL, GAP2 = "chr(10)", "chr(10) || chr(10)"


def bullets(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda k: '- ' || k), {NL})"


def block(text: str) -> str:
    """A Python string as SQL, newlines spelled out."""
    return " || chr(10) || ".join(s(line) for line in text.split("\n"))


HEAD = f"{title('''replace(cluster, '-', ' ')''')}"
H1 = f"'## Suggested H1' || {NL} || '> ' || {title('targets[1]')}"
TARGETS = f"'## Target Keywords' || {NL} || {bullets('targets')} || {NL} || CASE WHEN n > 10 THEN '- ... and ' || (n - 10) || ' more' ELSE '' END"
QUESTIONS = f"'## Questions to Answer' || {NL} || CASE WHEN len(questions) > 0 THEN {bullets('questions')} ELSE '- No question-style keywords detected' END"
ADVICE = (
    f"'## Content Recommendations' || {NL} || '- **Funnel Stage:** ' || funnel || {NL} || '- **Word Count:** ' || "
    f"{LENGTH.format(c='primary_intent')} || {NL} || '- **Content Type:** ' || {TYPE.format(c='primary_intent')}"
)
COUNTS = (
    f"'- **Keywords:** ' || n || {NL} || '- **Avg. Search Volume Score:** ' || printf('%.2f', interest) || {NL} || "
    "'- **Avg. Difficulty Score:** ' || printf('%.2f', difficulty)"
)


def _checklists() -> tuple[str, str]:
    from kwloom.operators import reports

    return reports.BRIEF_CHECKLIST, reports.GEO_BRIEF_CHECKLIST


CHECK, GEO_CHECK = _checklists()
OVERVIEW = f"'## Overview' || {NL} || '- **Primary Intent:** ' || {title('primary_intent')} || {NL} || {COUNTS}"
add(
    "o12_content_brief",
    f"""SELECT cluster, '# Content Brief: ' || {HEAD} || {GAP2} || {OVERVIEW} || {GAP2} || {H1} || {GAP2} || {TARGETS} || {GAP2}
  || {QUESTIONS} || {GAP2} || {ADVICE} || {GAP2} || {block(CHECK)} AS brief FROM parts""",
    "parts",
)
MARKET = (
    f"'## Market Overview' || {NL} || '- **Target Geo:** AE' || {NL} || '- **Primary Intent:** ' || {title('primary_intent')} "
    f"|| {NL} || {COUNTS} || {NL} || '- **Avg. CTR Potential:** ' || printf('%.2f', ctr)"
)
WHERE_TO = (
    f"'## Geographic Targeting' || {NL} || '- **Emirates Covered:** ' || CASE WHEN len(regions) > 0 THEN array_to_string(regions, ', ') "
    f"ELSE 'None specified (consider adding location modifiers)' END || {NL} || '- **Districts/Areas:** ' || "
    f"CASE WHEN len(districts) > 0 THEN array_to_string(districts[1:5], ', ') ELSE 'N/A' END || {NL} || "
    "'- **Recommended Location Variants:** ' || targets[1] || ' dubai, ' || targets[1] || ' abu dhabi, ' || targets[1] || ' sharjah'"
)
LOCAL = (
    f"'## UAE/Gulf-Specific Requirements' || {NL} || '- [ ] Include local regulatory terms (permits, approvals, licenses)' || {NL} || "
    f"'- [ ] Reference specific Emirates (' || CASE WHEN len(regions) > 0 THEN array_to_string(regions[1:3], ', ') ELSE 'Dubai, Abu Dhabi' END || ')' "
    f"|| {NL} || '- [ ] Add local trust signals (DED license, years in UAE, local portfolio)' || {NL} || "
    f"'- [ ] Include UAE-relevant pricing info (AED, VAT considerations)' || {NL} || "
    "'- [ ] Add location-specific schema markup (LocalBusiness, Service)'"
)
add(
    "o13_geo_brief",
    f"""SELECT cluster, '# GEO Content Brief: ' || {HEAD} || {GAP2} || {MARKET} || {GAP2} || {H1} || {GAP2} || {TARGETS} || {GAP2}
  || {WHERE_TO} || {GAP2} || {QUESTIONS} || {GAP2} || {ADVICE} || {GAP2} || {LOCAL} || {GAP2} || {block(GEO_CHECK)} AS brief
FROM (SELECT p.*, coalesce(e.regions, []) AS regions, coalesce(e.districts, []) AS districts FROM parts p LEFT JOIN (
  SELECT cluster, coalesce(list_sort(list(DISTINCT emirate) FILTER (emirate IS NOT NULL)), []) AS regions,
    coalesce(list_sort(list(DISTINCT district) FILTER (district IS NOT NULL)), []) AS districts
  FROM item_tags WHERE is_local GROUP BY cluster) e ON e.cluster = p.cluster)""",
    "parts", "item_tags",
)
add(
    "o14_results_table",
    f"""SELECT keyword, cluster, intent, funnel_stage, printf('%.2f', ri) AS interest, printf('%.2f', d) AS difficulty,
  printf('%.2f', o) AS opportunity, greatest((SELECT count(*) FROM items) - 25, 0) AS remaining FROM (
  SELECT keyword, cluster, intent, funnel_stage, relative_interest AS ri, difficulty AS d, opportunity_score AS o
  FROM items ORDER BY {RANKING} LIMIT 25)""",
    "items",
)


# --- flagship ---------------------------------------------------------------------------------

DEFAULT_ARTIFACT = {
    "codes": lx.MARKET_CODES, "navigation": lx.NAVIGATION_EXACT, "auth_terms": lx.AUTH_TERMS,
    "switches": lx.LANGUAGE_SWITCHES, "leads": lx.QUERY_LEADS, "switch_codes": lx.SWITCH_CODES,
    "prepositions": lx.CODE_PREPOSITIONS, "artifact_tokens": lx.ARTIFACT_TOKENS,
}
DEFAULT_STOP = {"prefixes": lx.STOP_PHRASE_PREFIXES, "geo_tokens": lx.GEO_TOKENS, "fillers": lx.STOP_PHRASE_FILLERS}
DEFAULT_CONFLICT = {"cities": lx.CONFLICT_CITIES, "connectors": lx.CONFLICT_CONNECTORS}
DEFAULT_PHRASE = {
    "navigation": lx.NAVIGATION_PHRASES, "prepositions": lx.DANGLING_PREPOSITIONS,
    "common_words": lx.COMMON_WORDS, "temporal_names": lx.TEMPORAL_NAMES,
}
REJECTED = " OR ".join(
    [
        artifact_sql("keyword", DEFAULT_ARTIFACT), grammar_sql("keyword", lx.INVALID_STARTS),
        conflict_sql("keyword", DEFAULT_CONFLICT), any_token(TOK, lx.NEGATIVE_TERMS),
        stop_phrase_sql("keyword", DEFAULT_STOP), numeric_sql("keyword"),
        "NOT (NOT contains(keyword, 'near me') OR (len(string_split(keyword, 'near me')) = 2 AND ends_with(keyword, 'near me')))",
        f"len({TOK}) NOT BETWEEN 2 AND 6", "length(keyword) < 5", phrase_sql("keyword", DEFAULT_PHRASE),
    ]
)
define(
    "kept",
    f"""SELECT keyword, coalesce(c.n, 0) AS freq, false AS validated, {starts_any('keyword', lx.QUESTION_LEADS, ' ')} AS is_question
  FROM kw LEFT JOIN counted c ON c.g = keyword WHERE NOT ({REJECTED})""",
    "kw", "counted",
)


def default_intent() -> str:
    cases = []
    for name, terms in lx.INTENT_RULES.items():
        cond = f"({contains_any('keyword', [t for t in terms if ' ' in t])} OR {any_token(TOK, [t for t in terms if ' ' not in t])})"
        cases.append((cond, s(name)))
    cases += [(any_token(TOK, t), s(n)) for n, t in lx.INTENT_SIGNALS.items()]
    return case(cases, "'informational'")


def default_ctr() -> str:
    hits = {f: contains_any("keyword", t) for f, t in lx.SERP_FEATURE_TRIGGERS}
    parts = [(c, f) for f, c in hits.items()]
    parts += [
        (f"(intent = 'informational' AND NOT {hits['featured_snippet']})", "people_also_ask"),
        ("(intent IN ('transactional', 'commercial'))", "top_ads"),
        (f"(intent = 'local' AND NOT {hits['local_pack']})", "local_pack"),
    ]
    out = "1.0::DOUBLE"
    for cond, f in parts:
        out = f"({out} * CASE WHEN {cond} THEN 1.0::DOUBLE - {lx.SERP_FEATURE_IMPACT[f]}::DOUBLE ELSE 1.0::DOUBLE END)"
    return f"greatest(0.2::DOUBLE, least(1.0::DOUBLE, {out}))"


define(
    "kept_raw",
    f"""SELECT *, {default_intent()} AS intent, {volume_sql(N_DOCS)} AS v,
    {difficulty_sql(N_DOCS, heads=lx.HEAD_TERMS)} AS d FROM kept""",
    "kept",
)
add(
    "ranked_keywords",
    f"""SELECT keyword, freq, intent,
  CASE intent WHEN 'informational' THEN 'TOFU' WHEN 'transactional' THEN 'BOFU' ELSE 'MOFU' END AS funnel_stage,
  round(ri, 9) AS relative_interest, round(di, 9) AS difficulty, round(ct, 9) AS ctr_potential,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ri * ct * (1.0::DOUBLE - di)
    * CASE WHEN intent IN ('informational', 'navigational') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END)), 9) AS opportunity_score
FROM (SELECT *, {ranked('kept_raw', 'v')} AS ri, {spread('kept_raw', 'd')} AS di, {default_ctr()} AS ct FROM kept_raw)""",
    "kept_raw",
)


def statements() -> dict[str, str]:
    return dict(Q)
