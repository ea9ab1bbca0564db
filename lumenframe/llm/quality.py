"""Quality rules: repetition counts and distribution divergence, with DataFrame operations only.

A document's histogram of character classes and its histogram of common words are compared with those
of its language by the Jensen-Shannon distance. The language references are the pooled histograms of
all documents of the language that pass the base rules. Short texts, whose histograms say little, are
not judged by a histogram (minimum-length guards).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, without

WORD = r"[^\x20\x09-\x0D]+"

# Frequent function words of some languages, the bins of the common-word histogram.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be by this are from at",
    "de": "der die und das in zu den mit von ist des ein eine auf sich als im auch nicht dem",
    "fr": "le la les de des et un une que qui en du au aux pour par sur pas est dans",
    "es": "el la los las de y que en un una se del por con para su al lo es como",
    "it": "il di che e la per un in non sono le si da con del una gli alla della nel",
    "pt": "o a de que e do da em um para com uma os no se na por mais as dos",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als bij",
}
BINS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
CLASSES = ["lower", "upper", "digit", "punctuation", "symbol", "space", "other_ascii", "beyond_ascii"]


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column, kind: str = "long") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Windows are compared by 64-bit hashes. Where all differ nothing repeats; else they are sorted with their places, and equal
    neighbours repeat. Each place then covers three words, less what the next place covers too.
    """
    windows = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce((k > 0) & (F.get(s, k - 1)["h"] == x["h"]), F.lit(False)))
    covered = lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    places = lambda h: let(placed(h), lambda s: F.transform(twice(s), lambda x: x["i"]))
    spread = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(places(h)), covered))
    return let(let(words, windows), spread)


def counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns, lang, the base columns and both histograms, in one pass over the texts."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    tokens = F.split(F.lower(text), r"[^\p{L}]+")
    hits = F.filter(tokens, lambda t: t.isin(BINS))
    # Common words by their place in BINS: comparing numbers costs far less than searching a string for each word.
    bins = F.array(*[F.lit(w) for w in BINS])
    numbers = F.transform(hits, lambda t: F.array_position(bins, t).cast("int"))
    d = docs.select(*carry, F.col("lang").alias("__lang"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    d = d.withColumn("__words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    d = d.withColumn("__base", F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.length(text).cast("double").alias("n"),
        F.when(F.octet_length(text) == F.length(text), 0.0).otherwise(counted(text, r"[^\x00-\x7F]")).alias("beyond"),
        counted(text, r"[\x00-\x08\x0E-\x1F\x7F+/=@\[\\\]^_`{}~]").alias("other"),
        counted(text, "[A-Z]").alias("upper"),
        counted(text, "[0-9]").alias("digit"),
        counted(text, r"""[.,;:!?'"()-]""").alias("punctuation"),
        F.size(tokens).cast("double").alias("n_tokens"),
        let(numbers, lambda x: F.array(*[(F.size(x) - F.size(F.array_remove(x, F.lit(i + 1)))).cast("double") for i in range(len(BINS))])).alias("common"),
    ))
    b = F.col("__base")
    space = b["n"] - b["word_chars"]
    lower = F.greatest(F.lit(0.0), b["n"] - b["upper"] - b["digit"] - b["punctuation"] - b["n_symbols"] - space - b["other"] - b["beyond"])
    return d.select(
        *carry,
        F.col("__lang").alias("lang"),
        *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])).alias("base_failed"),
        F.array(lower, b["upper"], b["digit"], b["punctuation"], b["n_symbols"].cast("double"), space, b["other"], b["beyond"]).alias("char_hist"),
        F.concat(b["common"], F.array(F.greatest(F.lit(0.0), b["n_tokens"] - total(b["common"], "double")))).alias("word_hist"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms, 0 if either is empty."""
    entropy_part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(v):
        parts = F.zip_with(v["p"], v["q"], lambda a, b: let(F.struct((a / v["n"]).alias("a"), (b / v["m"]).alias("b")), lambda s: entropy_part(s["a"], (s["a"] + s["b"]) / 2) + entropy_part(s["b"], (s["a"] + s["b"]) / 2)))
        return F.when((v["n"] > 0) & (v["m"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts, "double") / 2))).otherwise(0.0)

    return let(F.struct(p.alias("p"), q.alias("q"), total(p, "double").alias("n"), total(q, "double").alias("m")), of)


def language_references(feats: DataFrame) -> tuple[DataFrame, tuple[list[float], list[float]]]:
    """Pooled histograms ref_char, ref_word of each language ref_lang, and those of all documents together.

    Each document weighs 1 (its shares are summed), so that long texts do not dominate.
    """
    share = lambda h: let(F.struct(h.alias("h"), F.greatest(F.lit(1.0), total(h, "double")).alias("n")), lambda v: F.transform(v["h"], lambda x: x / v["n"]))
    n_c, n_w = len(CLASSES), len(BINS) + 1
    sums = lambda d, keys: d.groupBy(*keys).agg(
        F.count("*").alias("docs"),
        F.array(*[F.sum(F.col("c")[i]) for i in range(n_c)]).alias("ref_char"),
        F.array(*[F.sum(F.col("w")[i]) for i in range(n_w)]).alias("ref_word"),
    )
    shares = feats.where(~F.col("base_failed")).select("lang", share(F.col("char_hist")).alias("c"), share(F.col("word_hist")).alias("w"))
    by_lang = cut(sums(shares, ["lang"]))
    r = by_lang.agg(*[F.sum(F.col("ref_char")[i]) for i in range(n_c)], *[F.sum(F.col("ref_word")[i]) for i in range(n_w)]).first()
    pooled = [x or 0.0 for x in r]
    return by_lang.where(F.col("lang").isNotNull()).select(F.col("lang").alias("ref_lang"), "ref_char", "ref_word"), (pooled[:n_c], pooled[n_c:])


def judge(docs: DataFrame, max_char_distance: float = 0.25, word_distance: tuple[float, float] = (0.25, 1.5), min_chars: int = 200, min_words: int = 80, broadcast_languages: int = 256, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang, the base columns, char_distance, word_distance, kept, for every row of docs.

    kept is false for a document that fails the base rules, that has at least min_chars characters in
    words and a character-class distance above max_char_distance, or at least min_words words and a
    common-word distance above word_distance[0] + word_distance[1] / sqrt(n_words): the sampling noise of
    a histogram falls with the root of its size. A null or empty text has no words and fails the base
    rules. A language is compared with its own documents, however many languages there are (more than broadcast_languages are
    joined without a broadcast); a null one, or one of which no document passes the base rules, with all documents together.
    Very long texts are read whole. Repeated rows are judged alike, an empty table gives no rows. carry: the columns of docs that pass through (one named like a new column
    gives way); others are ignored.
    """
    new = {"lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_hist", "word_hist", "char_distance", "word_distance", "kept"}
    feats = cut(features(docs, [c for c in carry if c not in new]))
    table, pooled = language_references(feats)
    if table.limit(broadcast_languages + 1).count() <= broadcast_languages:
        table = F.broadcast(table)
    as_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    d = feats.join(table, F.col("lang") == F.col("ref_lang"), "left")
    d = d.withColumn("char_distance", F.round(js_distance(F.col("char_hist"), F.coalesce("ref_char", as_array(pooled[0]))), 6)).withColumn(
        "word_distance", F.round(js_distance(F.col("word_hist"), F.coalesce("ref_word", as_array(pooled[1]))), 6)
    )
    odd_chars = (F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)
    odd_words = (F.col("n_words") >= min_words) & (F.col("word_distance") > word_distance[0] + word_distance[1] / F.sqrt("n_words"))
    return d.withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_words).drop("char_hist", "word_hist", "ref_lang", "ref_char", "ref_word")


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns, that are kept; rows are known by doc_id and a hash of the text."""
    keyed = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("__body"))
    return without(docs, judge(keyed, carry=("doc_id", "__body"), **options).where("NOT kept").select("doc_id", F.col("__body").alias("body")))
