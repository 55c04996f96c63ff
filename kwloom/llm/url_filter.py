"""URL filters: pattern rules found by their rarest token, and host rules by suffix.

A pattern rule is a URL pattern with ``*`` for anything, ``^`` for a separator or the end, ``||``
for the begin of a host label and ``|`` for either end of the URL. Every rule is filed under the
token of it that is rarest among the URLs judged; the tokens of a URL fetch candidate rules, and
only their regular expressions run. Rules without a token that must occur whole run always.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import Sent

TOKEN = r"[a-z0-9%]{2,}"
#: Words that open or close a label of hosts nobody wants to read.
HOST_WORDS = (
    "ads adserver adserv adtrack banners clickbait clicks popunder popups tracker tracking doubleclick "
    "casino casinos poker slots roulette bet bets betting bingo jackpot lottery gambling "
    "pills pharma pharmacy viagra cialis xanax steroids weightloss "
    "adult xxx porn sex escorts hookup webcam camgirls "
    "spam phish phishing malware warez cracks keygen torrents nulled linkfarm doorway "
    "payday loans forex binaryoptions getrich replica replicas"
).split()
#: Fixed values: (action, pattern). Exceptions (allow) win over blocks.
PAGE_RULES = (
    ("block", "/wp-login.php"),
    ("block", "/cgi-bin/"),
    ("block", "/checkout/"),
    ("block", "^add-to-cart="),
    ("block", "^phpsessid="),
    ("block", "^jsessionid="),
    ("block", "^replytocom="),
    ("block", "/search?*q="),
    ("allow", "/robots.txt|"),
)


def host_word_rules(words: Iterable[str] = HOST_WORDS) -> list[tuple[str, str]]:
    """A rule for each form of a host label that opens or closes with a word, or is one."""
    forms = ("||{}.", "||{}-", "||*-{}.")
    return [("block", form.format(w)) for w in words for form in forms]


PATTERN_RULES = (*host_word_rules(), *PAGE_RULES)
#: Fixed values: (action, host, path) of the host rules.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Rule:
    """A pattern rule; ``tokens`` are those that every URL it matches holds whole."""

    action: str
    pattern: str

    @property
    def regex(self) -> str:
        text, lead, tail = self.pattern.lower(), "", ""
        if text.startswith("||"):
            text, lead = text[2:], r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?"
        elif text.startswith("|"):
            text, lead = text[1:], "^"
        if text.endswith("|"):
            text, tail = text[:-1], r"\Z"
        if lead.startswith(r"^[a-z]") and text.startswith("*"):
            text, lead = text[1:], lead + r"[^/?#.]*"  # inside the label
        parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%\-]|\Z)"}
        return lead + "".join(parts.get(c) or re.escape(c) for c in text) + tail

    @property
    def tokens(self) -> list[str]:
        bare, text = self.pattern.lower().strip("|"), self.pattern.lower()
        offset = len(text) - len(text.lstrip("|"))
        found = []
        for m in re.finditer(TOKEN, bare):
            before = bare[m.start() - 1] if m.start() else ("|" if offset else "*")
            after = bare[m.end()] if m.end() < len(bare) else ("|" if text.endswith("|") else "*")
            if before != "*" and after != "*" and not re.match("[a-z0-9%]", before + after):
                found.append(m.group())
        return found


def index(rules: Sequence[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token (ties: the first in order), and the rules without one."""
    filed: dict[str, list[int]] = {}
    rest = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            filed.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
        else:
            rest.append(i)
    return filed, rest


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest host rule that fits; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules of one
    length: the one first in order of its text.
    """
    which, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        which = F.when(fits, F.lit(name + start)).otherwise(which)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return which, action


def rule_table(rules: DataFrame) -> list[tuple[str, str]]:
    """(action, pattern) rows of a table; its index goes to every task, so it is a list in size."""
    return [(r.action, r.pattern) for r in rules.select("action", "pattern").distinct().orderBy("pattern", "action").collect()]


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs (column ``url``) hold each token of the rules; of the rules' bounded size."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    table = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))  # the rules' tokens
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    return {r.token: r["count"] for r in tokens.join(table, "token").groupBy("token").count().collect()}


def match(urls: DataFrame, rules: Sequence[Rule]) -> Column:
    """The action of the pattern rules for a URL column: block, or allow (also without a match).

    The rules are a list the caller holds, so their index goes to every task.
    """
    filed, rest = index(rules, token_counts(urls, rules))
    shared = Sent(urls.sparkSession, (list(rules), filed, rest))

    @F.pandas_udf("string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules, filed, rest = shared.value
        compiled = [re.compile(r.regex, re.DOTALL) for r in rules]
        token = re.compile(TOKEN)

        def one(url: str | None) -> str:
            text = (url or "").lower()
            found = {i for t in set(token.findall(text)) for i in filed.get(t, ())}.union(rest)
            hits = {rules[i].action for i in found if compiled[i].search(text)}
            return "block" if hits == {"block"} else "allow"

        for batch in batches:
            yield pd.Series([one(u) for u in batch], dtype=object)

    return judge


def judge(
    df: DataFrame, url_col: str = "url", id_col: str = "page_id",
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    pattern_rules: Iterable[tuple[str, str]] = PATTERN_RULES,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every URL.

    The longest fitting host rule decides; without one the pattern rules do, exceptions first;
    :func:`rule_table` reads them from a table of any source. Ties go to the rule first in order.
    A null URL, an empty one and one without ``://`` have an empty host and path and no host
    rule; pattern rules see a null URL as empty. Repeated rows and null ids give a row each.
    A URL of any length is judged whole; an empty table gives no rows. Extra columns are not read.
    """
    rules = [Rule(*r) for r in pattern_rules]
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    method = match(urls, rules)
    which, action = host_rule(F.col("host"), F.col("path"), host_rules)
    return (
        urls.select("id", "url", F.coalesce(host_of("url"), F.lit("")).alias("host"), F.coalesce(path_of("url"), F.lit("")).alias("path"))
        .select(F.col("id").alias(id_col), "host", "path", which.alias("rule"), F.coalesce(action, method("url")).alias("verdict"))
    )


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duckdb_sql(host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, pattern_rules: Iterable[tuple[str, str]] = PATTERN_RULES) -> str:
    """The same judgement in DuckDB SQL, every regular expression run on every URL."""
    ordered = sorted(host_rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        f"WHEN (host = {_sql_literal(h)} OR ends_with(host, {_sql_literal('.' + h)})) AND starts_with(path, {_sql_literal(p)})"
        for _, h, p in ordered
    ]
    which = " ".join(f"{w} THEN {_sql_literal(h + p)}" for w, (_, h, p) in zip(fits, ordered, strict=True))
    action = " ".join(f"{w} THEN {_sql_literal(a)}" for w, (a, _, _) in zip(fits, ordered, strict=True))

    def hit(kind: str) -> str:
        tests = [
            f"regexp_matches(lower(coalesce(url, '')), {_sql_literal(Rule(a, p).regex.replace(chr(92) + 'Z', chr(92) + 'z'))}, 's')"
            for a, p in pattern_rules if a == kind
        ]
        return "(" + (" OR ".join(tests) or "false") + ")"

    return f"""
WITH cut AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages)
SELECT page_id, host, path, CASE {which} END AS rule,
  CASE {action} WHEN {hit('block')} AND NOT {hit('allow')} THEN 'block' ELSE 'allow' END AS verdict
FROM cut"""
