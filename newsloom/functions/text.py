"""Text expressions. JavaScript's white space, word boundaries and rounding are kept where results depend on them."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that JavaScript's ``trim`` and ``\s`` know.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Zones of RFC 822 and their offsets.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
TERM = r"([A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*|\d+(?:\.\d+)?)"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def trimmed_at_least(c: Column, n: int) -> Column:
    """Whether the trimmed text has at least ``n`` (2 or more) characters. Reads no further than shows it."""
    return c.rlike(f"(?s)^{SPACE}*+(?!{SPACE}).{{{n - 1}}}.*?(?!{SPACE}).")


def collapse(c: Column, limit: int | None = None) -> Column:
    """White space runs as one space, trimmed, cut."""
    out = js_trim(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.substring(out, 1, limit) if limit else out


def keyword_pattern(keywords: list[str], short: int = 3) -> str | None:
    """One alternation for all keywords: those of at most ``short`` characters need an ASCII word boundary on word-character sides."""
    parts = []
    for k in (k.lower() for k in keywords if k):
        body = re.escape(k)
        if len(k) <= short:
            body = (r"(?<![a-zA-Z0-9_])" if re.match(r"\w", k[0], re.ASCII) else "") + body + (r"(?![a-zA-Z0-9_])" if re.match(r"\w", k[-1], re.ASCII) else "")
        parts.append(body)
    return "|".join(parts) or None


def matches_keyword(text: Column, keywords: list[str]) -> Column:
    pattern = keyword_pattern(keywords)
    return F.lower(text).rlike(pattern) if pattern else F.lit(False)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that's computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rule_hits(text: Column, bonus_rules: list[tuple[list[str], int]], category_rules: list[tuple[str, list[str]]]) -> Column:
    """``bonus`` and ``category`` of a text. It's lowered once, each distinct keyword of all rules is looked for once (plain substrings), and
    the rules read the hits."""
    words = list(dict.fromkeys(k for ks in [*(ks for ks, _ in bonus_rules), *(ks for _, ks in category_rules)] for k in ks))
    place = {k: i for i, k in enumerate(words)}

    def decide(hits: Column) -> Column:
        met = lambda ks: functools.reduce(operator.or_, (F.get(hits, F.lit(place[k])) for k in ks), F.lit(False))
        bonus = functools.reduce(operator.add, (F.when(met(ks), points).otherwise(0) for ks, points in bonus_rules), F.lit(0))
        found = F.array_distinct(F.array_compact(F.array(*(F.when(met(ks), name) for name, ks in category_rules)).cast("array<string>")))
        return F.struct(bonus.alias("bonus"), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Other"))).alias("category"))

    return bound(F.lower(text), lambda low: bound(F.array(*(low.contains(k) for k in words)).cast("array<boolean>"), decide))


def keyword_bonus(text: Column, rules: list[tuple[list[str], int]]) -> Column:
    return rule_hits(text, rules, [])["bonus"]


def categorise(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return rule_hits(text, [], rules)["category"]


def crowd_bonus(raw: Column, scale: Column, weight: int = 18, most: int = 60) -> Column:
    """Votes on a log scale, capped; nothing for missing votes, none, or what is no number."""
    return F.when((raw > 0) & ~F.isnan(raw), F.least(F.lit(float(most)), F.round(weight * F.log10(raw * scale + 1))).cast("int")).otherwise(0)


def terms(c: Column) -> Column:
    """Latin terms and numbers."""
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(1))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^```(?:json)?\s*", ""), r"\s*```$", "")


def chunks(c: Column, size: int) -> Column:
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def excerpt(c: Column, size: int = 180) -> Column:
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size), f"{SPACE}+$", ""), F.lit("…"))).otherwise(c)


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, trimmed; the whole text if there are none."""
    out = F.filter(F.transform(F.split(c, r"\n\s*\n"), js_trim), lambda p: p != "")
    return F.when(F.size(out) > 0, out).otherwise(F.array(c))


def first_link(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"<(https?://[^|>]+)\|", 1), F.lit(""))


def page_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(c, F.lit("-"), F.lit("")), r"([0-9a-fA-F]{32})(?:\?|$)", 1), F.lit(""))


def escape_markup(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def article_line(title: Column, url: Column, summary: Column, abstract: Column, placeholder: str = "(no summary)") -> Column:
    body = F.coalesce(F.nullif(summary, F.lit("")), F.nullif(F.substring(abstract, 1, 160), F.lit("")), F.lit(placeholder))
    return F.concat(F.lit("*<"), url, F.lit("|"), escape_markup(title), F.lit(">*\n"), escape_markup(body))


def star_count(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(0))


def crowd_number(c: Column) -> Column:
    out = F.when(js_trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), js_trim(c).try_cast("double"))  # no 1d, which Java takes
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def retry_after(c: Column, now: Column, most: int = 7 * 86400) -> Column:
    """Seconds from a Retry-After header, trimmed: digits, or an HTTP date (a past one gives 0, a part of a second counts whole); null
    beyond 0 to ``most``, for other forms, or if the header has more than 128 characters."""
    raw = js_trim(c)
    date = F.try_to_timestamp(F.concat(F.substring(raw, 6, 20), F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))
    ahead = F.greatest(F.lit(0), F.ceil((F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / F.lit(1_000_000)))
    is_date = raw.rlike(r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$")
    seconds = F.when(raw.rlike(r"^\d+$"), raw.try_cast("long")).when(is_date & date.isNotNull(), ahead)
    return F.when((F.length(c) <= 128) & seconds.between(0, most), seconds)


def parse_date(c: Column) -> Column:
    """ISO dates first, then RFC 822 ones with or without weekday, with offsets or the zones that it names; null if neither."""
    rfc = F.regexp_replace(F.regexp_replace(c, r"^\s*\w{3},\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    for name, offset in ZONES.items():
        rfc = F.regexp_replace(rfc, rf"\b{name}$", offset)
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm Z")))


def month_label(month: Column) -> Column:
    return F.concat(F.substring(month, 1, 4), F.lit("年"), F.substring(month, 6, 2).cast("int").cast("string"), F.lit("月"))


def rail_width(score: Column, most: int = 110, least: int = 30) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(100), F.floor(100 * (score - least) / (most - least) + 0.5).cast("int")))


def fold(c: Column) -> Column:
    """NFKC and lower case; Spark has no built-in for NFKC, so this is an Arrow UDF."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC").str.lower()

    return nfkc(c)


def search(haystack: Column, query: str) -> Column:
    """Every white-space separated term of a folded query must occur."""
    out = F.lit(True)
    for term in query.split():
        out = out & haystack.contains(term)
    return out


def json_value(c: Column) -> Column:
    """A value as JSON text: null gives ``null``."""
    return F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1")


def json_tuple(*columns: Column) -> Column:
    """A JSON array of columns whose types may differ."""
    return F.concat(F.lit("["), F.concat_ws(",", *(json_value(c) for c in columns)), F.lit("]"))


def rich_text(parts: Column) -> Column:
    """The plain text of rich text parts, joined."""
    return F.array_join(F.transform(F.coalesce(parts, F.expr("array()")), lambda p: F.coalesce(p["plain_text"], F.lit(""))), "")
