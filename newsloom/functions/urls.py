"""URL keys as expressions over regular expressions, so that odd URLs don't raise and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.hosts import ascii_host
from newsloom.functions.text import bound

VALID = r"(?s)^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s<>^|]+([/?#].*)?$"
# What a path percent-encodes, and its segments for "here" and "up", as the URL standard has them.
ENCODED = r'\x00-\x20"<>`{}\x7f-\x{10ffff}'
HERE, UP = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def _clean(url: Column) -> Column:
    """Without outer controls and spaces, tabs and line ends; back slashes before the query are slashes."""
    url = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    head = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.when(head.contains("\\"), F.concat(F.translate(head, "\\", "/"), F.substr(url, F.length(head) + 1))).otherwise(url)


def _resolved(path: Column) -> Column:
    """The path without dot segments."""
    parts = F.split(path, "/")
    parts = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == F.size(parts) - 1).alias("last")))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up, end = part["s"].rlike(UP), F.when(part["last"], F.array(F.lit(""))).otherwise(none)
        under = F.when(up, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.concat(under, F.when(up | part["s"].rlike(HERE), end).otherwise(F.array(part["s"])))

    text = F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), none, step), "/"))
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), text).otherwise(path)


def _encoded(path: Column) -> Column:
    runs = F.regexp_extract_all(path, F.lit(f"[{ENCODED}]+|[^{ENCODED}]+"), 0)
    text = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{ENCODED}]"), F.regexp_replace(F.url_encode(r), r"\+", "%20")).otherwise(r)), "")
    return F.when(path.rlike(f"[{ENCODED}]"), text).otherwise(path)


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, host with port (default ports dropped), path, query."""
    url = _clean(url)
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), r"^[^@]*@", ""))
    host = bound(host, lambda h: F.when(h.rlike("%[0-9a-f]{2}"), F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)).otherwise(h))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":$")
    host = F.regexp_replace(ascii_host(host), port, F.lit(""))
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return scheme, host, _encoded(_resolved(path)), query


def _pairs(query: Column, drop: str) -> Column:
    """``name`` (decoded), ``i``, ``p`` (``name=value``, form-encoded) of the parameters whose names don't match ``drop``."""

    def decoded(text: Column) -> Column:
        return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))

    def pair(p: Column, i: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.substr(p, F.length(name) + 2)
        return F.struct(decoded(name).alias("name"), i.alias("i"), F.concat(F.url_encode(decoded(name)), F.lit("="), F.url_encode(decoded(value))).alias("p"))

    return F.filter(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), lambda s: ~s["name"].rlike(drop))


def _query(pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.transform(pairs, lambda s: s["p"]), "&"))).otherwise("")


def url_key(url: Column) -> Column:
    """The dedup key: no scheme, fragment, leading ``www.``, tracking parameters or last slash; parameters by name, stable.

    Dot segments are resolved, paths percent-encoded and parameters form-encoded, so that spellings of one URL meet. What isn't
    a URL becomes its lower-cased self. Hosts are in ASCII, so that one that's written both ways has one key.
    """
    _, host, path, query = _parts(url)
    kept = F.array_sort(_pairs(query, r"(?s)^(utm_.*|ref|fbclid|gclid)$"))
    key = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", ""), _query(kept))
    return F.when(_clean(url).rlike(VALID), key).otherwise(F.lower(url))


def fetch_url(url: Column) -> Column:
    """The URL as fetched: no fragment and none of four tracking parameters; the scheme stays; an invalid URL is unchanged."""
    scheme, host, path, query = _parts(url)
    kept = _pairs(query, "^(utm_source|utm_medium|utm_campaign|ref)$")
    out = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), _query(kept))
    return F.when(_clean(url).rlike(VALID), out).otherwise(url)


def spellings(url: Column) -> Column:
    """The URL and the eight spellings of its key: two schemes, with and without ``www.`` and a last slash."""


    def spelled(key: Column) -> Column:
        base, query = F.substring_index(key, "?", 1), F.when(key.contains("?"), F.concat(F.lit("?"), F.substring_index(key, "?", -1))).otherwise("")
        has_path = base.contains("/")
        out = [url]
        for scheme in ("https://", "http://"):
            for www in ("", "www."):
                head = F.concat(F.lit(scheme + www), base)
                out += [F.concat(head, F.when(has_path, "").otherwise("/"), query), F.concat(head, F.when(has_path, "/").otherwise(""), query)]
        return F.array_distinct(F.array(*out))

    return bound(url_key(url), spelled)


def article_id(url: Column) -> Column:
    return F.sha2(url_key(url), 256)


def host_in(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or under one."""
    host, out = F.regexp_replace(_parts(url)[1], r":\d+$", ""), F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out
