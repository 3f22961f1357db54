"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

Labelled pages (``labels.doc_id`` is the page's id; low quality or toxic means bad) give baskets: a distinct URL's tokens and its
class (a URL with pages of both classes is a basket of each, so that repeating a page doesn't make its URL frequent). Tokens that
stand in the same baskets are one item. FP-growth mines frequent combinations, where no basket has more than ``MOST_ITEMS`` items; as it
lists all combinations, tables with longer baskets are mined level by level instead, by combinations that can still give a rule
(``_free_sets``). Both give the same rules, from all items of all baskets: rules that lead to the bad class stay if their confidence and
support reach the bounds, and go if a rule on part of their items is as confident. Stated rules on host and path come first.

An inverted index matches URLs: a rule is listed under the tokens of its rarest item, and fits a URL that has a token of each item.
A null URL, or one without ``://``, has an empty host and path, no tokens, and passes. Rows that repeat are judged each. Of rules
that fit, the most confident is named, of equals the one of the largest number. Empty tables give empty results; other columns
stay, but those named like the results. URLs of any length are judged whole: matching sees all of their tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, quoted

BAD = "class:bad"
#: Stated rules: host and path, verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Items of a basket up to which FP-growth mines the tables; with more they're mined level by level.
MOST_ITEMS = 18
#: Bytes of rules that are broadcast; more are joined by a shuffle.
MOST_RULE_BYTES = 16_000_000
#: A URL of more than a thousandth of the rows, and of this many at least, is broadcast if it isn't longer than so many characters.
MOST_COMMON, COMMON_ROWS, COMMON_CHARS = 1000, 1000, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What stands after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, host labels, path parts (numbers as ``0``), query keys and fragment."""
    host, rest = host_of(url), _rest(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(path_of(url), r"\d+", "0"), r"[/.]"), lambda x: x != "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^(.*?)://", 1)), F.concat(F.lit("host:"), host)),
        named("label:", labels), named("path:", parts), named("key:", keys),
        F.when(rest.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def stated(host: Column, path: Column, rules: dict[str, str] = RULES) -> tuple[Column, Column]:
    """The longest stated rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tested first, as it's outermost
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


RULE = "rule bigint, items array<string>, confidence double, support double, slots array<struct<n:bigint,tokens:array<string>>>"


def mine(pages: DataFrame, labels: DataFrame, scratch: Scratch, min_support: float = 0.001, min_count: int = 10, min_confidence: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rules from URL tokens to the bad class: ``rule``, ``items`` (a token for each), ``confidence``, ``support`` (share of the baskets), and
    ``slots``, each item's baskets and tokens."""
    from pyspark.ml.fpm import FPGrowth

    worst = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    known = pages.select(F.col(id_col).alias("__page"), F.col(url_col).alias("url")).join(worst, F.col("__page") == F.col("__id"))
    bad = (F.coalesce("q", F.lit(1)) == 0) | (F.coalesce("t", F.lit(0)) == 1)
    baskets = known.filter("url IS NOT NULL").select("url", bad.alias("bad")).distinct().withColumn("tokens", tokens_of(F.col("url"))).filter("size(tokens) > 0")
    baskets = scratch.write(baskets.select(F.xxhash64("url", "bad").alias("a"), F.xxhash64(F.lit("b"), "url", "bad").alias("b"), "bad", "tokens"), "baskets")
    n, n_bad = baskets.agg(F.count("*"), F.sum(F.col("bad").cast("int"))).first()
    if not n:
        return pages.sparkSession.createDataFrame([], RULE)
    least = max(min_support, min_count / n)
    # tokens of the same baskets, told by hashes over these, are one item
    each = baskets.select("a", "b", "bad", F.explode("tokens").alias("token"))
    tokens = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.sum(F.col("bad").cast("int")).alias("n_bad")).filter(F.col("n") >= least * n)
    items = tokens.groupBy("n", "x", "y", "n_bad").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    items = scratch.write(items.select(F.element_at("tokens", 1).alias("item"), "n", "tokens"), "items")
    named = each.join(items.select("item", F.explode("tokens").alias("token")), "token").groupBy("a", "b", "bad").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = scratch.write(named.select("items", "bad"), "named")
    n_named, most = named.agg(F.count("*"), F.max(F.size("items"))).first()
    # support is a share of the baskets with a frequent token
    support = min(1.0, least * n / max(1, n_named))
    if (most or 0) <= MOST_ITEMS:
        classed = named.select(F.array_append("items", F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit("class:good"))).alias("items"))
        # confidence 0: the pruning below needs all of a rule's parts
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(classed)
        found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.sort_array("antecedent").alias("items"), "confidence", "support")
    else:
        found = _free_sets(named, math.ceil(support * n_named), n_named, scratch)
    found = scratch.write(found.select(F.xxhash64("items").alias("rule"), "items", F.size("items").alias("k"), "confidence", "support"), "mined")
    rules = _unshadowed(found, scratch).filter(F.col("confidence") >= min_confidence)
    slots = rules.select("rule", F.explode("items").alias("item")).join(items, "item").groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("slots"))
    rules = scratch.write(rules.join(slots, "rule").select("rule", "items", "confidence", "support", "slots"), "rules")
    scratch.drop("baskets", "items", "named", "mined")
    return rules


def _free_sets(named: DataFrame, least: int, n: int, scratch: Scratch) -> DataFrame:
    """``items``, ``confidence`` and ``support`` of the combinations in at least so many bad baskets, but for those that ``_unshadowed`` would drop.

    A combination whose good baskets are those of one of its parts is no more confident than that part, and with any further items no more
    than the part with them; one without good baskets can't be bettered. So only a combination that has fewer good baskets than each
    of its parts, and has some, is extended, and only if all parts of the longer one are such. A level's occurrences (a combination and
    the items of a basket after its last) are a table; it grows with the combinations that may give rules, however long the baskets are."""
    baskets = named.groupBy("items", "bad").agg(F.count("*").alias("w"))
    ids = F.transform("items", lambda x: F.xxhash64(x))
    each = baskets.select("bad", "w", "items", ids.alias("ids"), F.posexplode("items").alias("at", "item"))
    after = lambda xs, at: F.slice(xs, at + 1, F.size(xs))
    met = each.select(F.xxhash64(F.array("item")).alias("rule"), F.array("item").alias("items"), "bad", "w", after(F.col("ids"), F.col("at") + 1).alias("rest"))
    n_good = F.sum(F.when(~F.col("bad"), F.col("w")).otherwise(0))
    sets = met.groupBy("rule").agg(F.first("items").alias("items"), F.sum(F.when(F.col("bad"), F.col("w")).otherwise(0)).alias("n_bad"), n_good.alias("n_good")).filter(F.col("n_bad") >= least)
    all_good = baskets.filter("NOT bad").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    sets = scratch.write(sets.withColumn("least_good", F.lit(all_good).cast("bigint")), "sets1")
    met = scratch.write(met.drop("items"), "met1")
    names = sets.select(F.xxhash64(F.get("items", F.lit(0))).alias("id"), F.get("items", F.lit(0)).alias("item"))
    found, k = sets, 1
    while True:
        free = sets.filter("n_good > 0 AND n_good < least_good").select("rule", "items", "n_good")
        longer = met.filter("bad").join(free.select("rule"), "rule").select("rule", "w", F.explode("rest").alias("id")).groupBy("rule", "id").agg(F.sum("w").alias("n_bad")).filter(F.col("n_bad") >= least)
        longer = longer.join(free.select("rule", "items"), "rule").join(names, "id")
        longer = longer.select(F.col("rule").alias("part"), "id", "n_bad", F.array_append("items", F.col("item")).alias("items")).withColumn("rule", F.xxhash64("items"))
        parts = longer.select("rule", F.explode(F.transform("items", lambda x: F.xxhash64(F.array_remove("items", x)))).alias("below"))
        whole = parts.join(free.select(F.col("rule").alias("below"), "n_good"), "below").groupBy("rule").agg(F.count("*").alias("n"), F.min("n_good").alias("least_good"))
        k += 1
        longer = scratch.write(longer.join(whole.filter(F.col("n") == k).drop("n"), "rule"), f"longer{k}")
        if longer.isEmpty():
            break
        next_met = met.join(longer.select(F.col("part").alias("rule"), "id", F.col("rule").alias("next")), "rule").withColumn("at", F.array_position("rest", F.col("id"))).filter("at > 0")
        next_met = scratch.write(next_met.select(F.col("next").alias("rule"), "bad", "w", after(F.col("rest"), F.col("at").cast("int")).alias("rest")), f"met{k}")
        good = next_met.filter("NOT bad").groupBy("rule").agg(F.sum("w").alias("n_good"))
        sets = longer.join(good, "rule", "left").select("rule", "items", "n_bad", F.coalesce("n_good", F.lit(0)).cast("bigint").alias("n_good"), "least_good")
        sets = scratch.write(sets, f"sets{k}")
        scratch.drop(f"met{k - 1}", f"longer{k}")
        met, found = next_met, found.unionByName(sets)
    scratch.drop(f"met{k - 1}", f"longer{k}")
    return found.select("items", (F.col("n_bad") / (F.col("n_bad") + F.col("n_good"))).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"))


def _unshadowed(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rules more confident than any on part of their items: level by level, a rule learns the best of its parts from those that lack
    one item. Levels are as many as a URL's tokens at most, and each joins a row for each item of its rules."""
    deepest = found.agg(F.max("k")).first()[0] or 0
    best, kept = None, found.filter("k = 1")
    for k in range(1, deepest + 1):
        level = found.filter(F.col("k") == k)
        if best is not None:
            parts = level.select("rule", F.explode(F.transform("items", lambda x: F.xxhash64(F.array_remove("items", x)))).alias("part"))
            below = parts.join(best, "part").groupBy("rule").agg(F.max("best").alias("below"))
            level = level.join(below, "rule", "left")
            kept = kept.unionByName(level.filter(F.coalesce(F.col("confidence") > F.col("below"), F.lit(True))).drop("below"))
            level = level.withColumn("confidence", F.greatest("confidence", F.col("below")))
        best = scratch.write(level.select(F.col("rule").alias("part"), F.col("confidence").alias("best")), f"best{k}")
    return kept


def matches(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``url``, ``rule``: the most confident rule that fits each distinct URL (ties: by number); others are absent."""
    index = rules.select("rule", "confidence", "slots", F.explode(F.get("slots", F.lit(0))["tokens"]).alias("token"))
    if (index.agg(F.sum(F.length(F.to_json("slots")))).first()[0] or 0) <= MOST_RULE_BYTES:
        index = F.broadcast(index)  # so that tokens of all URLs don't move
    distinct = urls.select(F.col(quoted(url_col)).alias("url")).filter("url IS NOT NULL").distinct()
    tokens = distinct.select("url", tokens_of(F.col("url")).alias("tokens")).select("*", F.explode("tokens").alias("token"))
    met = tokens.join(index, "token").filter(F.forall("slots", lambda s: F.arrays_overlap(s["tokens"], "tokens")))
    return met.groupBy("url").agg(F.max(F.struct("confidence", "rule"))["rule"].alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", by_hand: dict[str, str] = RULES) -> DataFrame:
    """The rows' other columns with ``host``, ``path``, ``rule``, ``verdict`` and ``mined_rule`` (columns of these names are replaced).

    A URL of very many rows is broadcast with its rule (or none), at most ``MOST_COMMON`` of them; its rows, and those without a URL, stay where they are."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "mined_rule")]
    found = matches(pages, rules, url_col)
    is_hot = (F.col("n") > max(COMMON_ROWS, pages.count() // MOST_COMMON)) & (F.length("hot_url") <= COMMON_CHARS)
    hot = pages.groupBy(F.col(quoted(url_col)).alias("hot_url")).agg(F.count("*").alias("n")).filter(is_hot).drop("n")
    hot = hot.join(found, F.col("hot_url") == F.col("url"), "left").select("hot_url", F.col("rule").alias("mined"))
    # numbered, as the rows' own columns may have any names
    rows = pages.select(F.col(quoted(url_col)), *map(quoted, kept)).toDF("url", *(f"c{i}" for i in range(len(kept))))
    rows = rows.join(F.broadcast(hot), F.col("url") == F.col("hot_url"), "left")
    still = rows.filter("url IS NULL OR hot_url IS NOT NULL").drop("hot_url")  # not joined by URL, so not gathered
    others = rows.filter("url IS NOT NULL AND hot_url IS NULL").drop("hot_url", "mined")
    others = others.join(found.select(F.col("url").alias("rest_url"), F.col("rule").alias("mined")), F.col("url") == F.col("rest_url"), "left").drop("rest_url")
    rows = still.unionByName(others)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = stated(F.col("host"), F.col("path"), by_hand)
    verdict = F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("mined").alias("mined_rule"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = mine(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "url-rules"))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
