"""URL filtering: a rule list, and association rules that Spark's FP-growth mines from labelled URLs.

A URL is a transaction of tokens (host parts, path words, query keys, fragment). The URLs that the rule list
decides are labelled by it; FP-growth finds the token combinations that go with a label often enough. Rules below
the least support or confidence, and rules that a shorter one covers, are pruned. A URL that the rule list leaves
open is matched through an inverted index that holds each mined rule under its rarest token.

FP-growth lists every subset of tokens that stand together, which doubles with each token. Two exact reductions come
first: tokens that stand in the same transactions are one item, and an item that goes with one label alone is a rule
by itself, which no longer rule with it can better, so that it is not mined further.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

# The rules of the contract.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@dataclass(frozen=True)
class Mining:
    """max_broadcast_rules: more mined rules, or tokens of items, than that are joined without a broadcast."""

    min_support: float = 0.01
    min_confidence: float = 0.8
    max_broadcast_rules: int = 20000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        host = F.replace(host, F.lit(a), F.lit(a.lower()))
    return host


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)


def decided(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), both null where none does."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in reversed(longest):
        rule, verdict = F.when(rule_fits(r), F.lit(r)).otherwise(rule), F.when(rule_fits(r), F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL with host and path columns beside it. Runs of digits become #."""
    tagged = lambda tag, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    words = F.filter(F.split("host", r"[.-]"), lambda x: F.length(x) > 2)
    return F.array_distinct(
        F.concat(
            tagged("host:", F.array_union(F.split("host", r"[.]"), words)),
            tagged("path:", F.split(F.lower("path"), r"[/._-]")),
            tagged("query:", keys),
            tagged("fragment:", F.array(F.regexp_extract(u, r"(?s)#(.*)", 1))),
        )
    )


def mixed() -> Column:
    return (F.col("blocks") > 0) & (F.col("blocks") < F.col("freq"))


def items_of(labelled: DataFrame, least: int) -> DataFrame:
    """token, item, blocks, freq of each token in at least `least` of the rows (row, tokens, verdict).

    Tokens with equal row sets (count and 128 bits of parity of row hashes) share an item, the first of them by code
    point. There are at most as many such tokens as a mean row has, divided by the least share of rows.
    """
    per_token = labelled.select("row", "verdict", F.explode("tokens").alias("token")).groupBy("token")
    sets = per_token.agg(
        F.count(F.lit(1)).alias("freq"),
        F.count_if(F.col("verdict") == "block").alias("blocks"),
        F.bit_xor(F.xxhash64("row")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "row")).alias("h2"),
    )
    sets = cut(sets.where(F.col("freq") >= least))
    first = sets.groupBy("freq", "h1", "h2").agg(F.min("token").alias("item"))
    return cut(sets.join(first, ["freq", "h1", "h2"]).select("token", "item", "blocks", "freq"))


def in_items(rows: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """rows (row, tokens) with the distinct items of their tokens, and those that go with both labels; tokens that are in no item are left out."""
    named = items.select("token", "item", mixed().alias("both"))
    held = rows.select("row", F.explode("tokens").alias("token")).join(F.broadcast(named) if small else named, "token")
    held = held.groupBy("row").agg(F.collect_set("item").alias("items"), F.collect_set(F.when(F.col("both"), F.col("item"))).alias("mixed"))
    none = F.array().cast("array<string>")
    return rows.join(held, "row", "left").withColumns({"items": F.coalesce("items", none), "mixed": F.coalesce("mixed", none)})


def mine(labelled: DataFrame, items: DataFrame, m: Mining, least: int) -> DataFrame:
    """rule_id, items, verdict, confidence, support, from rows with mixed items and verdict."""
    single = items.select("item", "blocks", "freq").distinct()
    pure = single.where(~mixed())
    alone_rules = pure.select(F.array("item").alias("items"), F.when(F.col("blocks") == 0, "allow").otherwise("block").alias("verdict"), F.lit(1.0).alias("confidence"), F.col("freq").alias("support"))
    baskets = labelled.select(F.concat("mixed", F.array(F.concat(F.lit("label:"), "verdict"))).alias("basket"))
    model = FPGrowth(itemsCol="basket", minSupport=m.min_support, minConfidence=m.min_confidence).fit(baskets)
    found = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    labels = F.filter("items", lambda x: x.startswith("label:"))
    with_label = found.where(F.size(labels) == 1).select(F.filter("items", lambda x: ~x.startswith("label:")).alias("items"), F.substring(labels[0], 7, 100).alias("verdict"), F.col("freq").alias("both")).where(F.size("items") > 0)
    alone = found.where(F.size(labels) == 0).select("items", "freq")
    rules = with_label.join(alone, "items").select("items", "verdict", (F.col("both") / F.col("freq")).alias("confidence"), F.col("both").alias("support")).where(F.col("confidence") >= m.min_confidence)
    rules = cut(rules.unionByName(alone_rules).withColumn("rule_id", F.xxhash64("items", "verdict")))
    # A rule goes if one with all but some of its items, the same verdict and no less confidence stays: compare each
    # with its sub-rules of one item less, which FP-growth has all found.
    smaller = rules.select("rule_id", "verdict", "confidence", F.explode(F.transform("items", lambda t: F.array_remove(F.col("items"), t))).alias("less"))
    covered = smaller.alias("s").join(rules.alias("r"), (F.col("s.less") == F.col("r.items")) & (F.col("s.verdict") == F.col("r.verdict")) & (F.col("r.confidence") >= F.col("s.confidence"))).select("s.rule_id")
    return cut(rules.join(covered.distinct(), "rule_id", "left_anti"))


def fits(rows: DataFrame, m: Mining) -> bool:
    return rows.limit(m.max_broadcast_rules + 1).count() <= m.max_broadcast_rules


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence for every row of pages.

    A URL that no rule of the list fits gets the verdict of the mined rule with the highest confidence, then the most
    support, then block before allow; allow if none matches. mined_confidence is null where no mined rule was needed
    or matched. A null url, or one without ://, has an empty host and path and no tokens. Repeated rows are judged
    each for itself and count each as a transaction; an empty table gives no rows; other columns are ignored. A long url
    is read whole, with all its tokens. Time doubles with each further token of a combination whose tokens stand with both
    labels, and each apart from the others in enough URLs to be an item of its own.
    """
    rule, verdict = decided(rules)
    read = pages.select("page_id", F.monotonically_increasing_id().alias("row"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("tokens", tokens_of(F.col("url"))).drop("url")
    read = cut(read)
    labelled = read.where(F.col("verdict").isNotNull())
    n = labelled.count()
    least = math.ceil(mining.min_support * n)
    unmined = read.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("mined_confidence"))
    if n == 0:
        return unmined
    items = items_of(labelled.select("row", "tokens", "verdict"), least)
    small = fits(items, mining)
    mined = mine(in_items(labelled.select("row", "tokens", "verdict"), items, small), items, mining, least)
    if mined.isEmpty():
        return unmined
    # The inverted index: each rule under the item that the fewest transactions hold.
    counts = items.select("item", "freq").distinct()
    index = mined.select("rule_id", F.explode("items").alias("item")).join(counts, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("freq", "item")).alias("item"))
    index = index.join(mined, "rule_id").select("item", F.col("items").alias("needs"), F.col("verdict").alias("mined"), "confidence", "support")
    if fits(mined, mining):
        index = F.broadcast(index)
    open_urls = in_items(read.where(F.col("verdict").isNull()).select("row", "tokens"), items, small).select("row", "items", F.explode("items").alias("item"))
    fired = open_urls.join(index, "item").where(F.size(F.array_except("needs", "items")) == 0)
    best = fired.groupBy("row").agg(F.max(F.struct("confidence", "support", (F.col("mined") == "block").alias("blocks"), "mined")).alias("m")).select("row", F.col("m.mined").alias("mined"), F.col("m.confidence").alias("mined_confidence"))
    return read.join(best, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"), "mined_confidence")
