"""Quality rules: divergence of a document from its language, by DataFrame functions only.

Method. A document's characters are counted by class and its words by a short
list of common words of its language. The same counts summed over all
documents of the language that pass the base rules are the reference. The
Jensen-Shannon distance (square root of the divergence with base-2 logarithms,
0 to 1) of both histograms is compared with a limit each; documents with few
words are too short for a verdict and are kept unless a base rule fails.

Nothing leaves the row except the sums per language: repeated five-word
windows are found in the row by sorting hashed windows (XXH64; two different
windows of one document would have to collide to count wrongly).

Rows. A null text has no words and fails the base rule. A language that is
null or has no list of common words is compared with its own documents' sums,
by characters only in effect. Repeated rows are judged each, and equally. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import SPACE_CLASS
from quadrat.storage import settle

#: Common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
}
#: Characters outside words are not counted; the last class is everything else.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": r"[#*$%&|<>]+", "mark": "[!-~]+"}

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Distance, fewest words for a verdict by it, and its limit.
LIMITS = (("char_distance", 20, 0.4), ("char_distance", 100, 0.25), ("word_distance", 100, 0.25),
          ("word_distance", 400, 0.2))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """Word, character, line and window counts of whole texts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars (by class), common
    (words of the language's list, then the rest), next to doc_id, lang and ``keep``.
    """
    spaces = F.lit(" \t\n\x0b\f\r")
    df = docs.select("doc_id", "lang", *keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    df = df.withColumn("_line", F.btrim("_text", spaces))
    df = df.withColumn("_words", F.when(F.col("_line") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("_line", SPACE_CLASS + "+")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, spaces) != "")
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])))
    df = df.select(
        "doc_id", "lang", *keep, n.cast("long").alias("n_words"), "_words", windows.alias("_windows"),
        F.array_join("_words", "").alias("_r0"), lines.alias("_lines"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    twice = F.col("_windows").isNotNull() & (F.size(F.array_distinct("_windows")) < F.size("_windows"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.drop("_lines").withColumn("_sorted", F.when(twice, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("_windows")
    ahead, behind = F.slice("_sorted", 1, F.size("_sorted") - 1), F.slice("_sorted", F.lit(2), F.size("_sorted"))
    same = F.zip_with(ahead, behind, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
        F.array().cast("array<int>")))
    df = df.withColumn("_starts", F.when(F.size("_sorted") > 0, F.sort_array(F.array_distinct(F.flatten(same))))
                       .otherwise(F.array().cast("array<int>"))).drop("_sorted")
    gaps = F.zip_with(F.slice("_starts", 1, F.size("_starts") - 1), F.slice("_starts", F.lit(2), F.size("_starts")),
                      lambda a, b: F.least(b - a, F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.when(F.size("_starts") > 0, F.aggregate(
        gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0).cast("long")).drop("_starts")
    df = df.withColumn("word_chars", F.char_length("_r0").cast("long"))
    left = F.col("_r0")
    steps = [left]
    for pattern in CLASSES.values():
        left = F.regexp_replace(left, pattern, "")
        steps.append(left)
    df = df.withColumn("_left", F.array(*[F.char_length(x) for x in steps], F.lit(0))).drop("_r0")
    df = df.withColumn("chars", F.zip_with(
        F.slice("_left", 1, len(steps)), F.slice("_left", 2, len(steps)), lambda a, b: (a - b).cast("long")))
    df = df.withColumn("n_symbols", F.get("chars", F.lit(list(CLASSES).index("symbol")))).drop("_left")
    lists = F.lit(None).cast("array<string>")
    for lang, own in COMMON.items():
        lists = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in own])).otherwise(lists)
    df = df.withColumn("_list", F.coalesce(lists, F.array().cast("array<string>")))
    df = df.withColumn("_hits", F.transform("_list", lambda w: (
        F.col("n_words") - F.size(F.array_remove("_words", w))))).drop("_words", "_list")
    rest = F.col("n_words") - F.aggregate("_hits", F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.withColumn("common", F.concat("_hits", F.array(rest))).drop("_hits")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def references(counted: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_common: summed counts of the language's documents that pass the base rules."""
    def summed(name: str, size: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0)) for i in range(size)]).alias(f"ref_{name}")
    return counted.where(~F.col("base_failed")).groupBy(F.col("lang").alias("ref_lang")).agg(
        summed("chars", len(CLASSES) + 1), summed("common", len(COMMON["en"]) + 1))


def distance(name: str) -> Column:
    """Jensen-Shannon distance of a document's counts and its reference's; 0 if either is empty."""
    def total(counts: str) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m) / 2).otherwise(0.0)
    p_all, q_all = total(name), total(f"ref_{name}")
    shares = F.zip_with(name, F.slice(f"ref_{name}", F.lit(1), F.size(name)), lambda a, b: F.struct(
        (a / p_all).alias("p"), (b / q_all).alias("q")))
    terms = F.transform(shares, lambda s: part(s["p"], (s["p"] + s["q"]) / 2) + part(s["q"], (s["p"] + s["q"]) / 2))
    found = F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    return F.when((p_all > 0) & (q_all > 0), found).otherwise(0.0)


def compared(counted: DataFrame, ref: DataFrame) -> DataFrame:
    """``counted`` with char_distance and word_distance to its language's reference, and ``far``."""
    df = counted.join(ref, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    df = df.withColumn("char_distance", F.coalesce(distance("chars"), F.lit(0.0)))
    df = df.withColumn("word_distance", F.coalesce(distance("common"), F.lit(0.0)))
    return df.withColumn("far", far()).drop("ref_lang", "ref_chars", "ref_common")


def far() -> Column:
    """Too far from the language, by the limit for the document's number of words."""
    n = F.col("n_words")
    limits = [(n >= least) & (F.col(column) > limit) for column, least, limit in LIMITS]
    return limits[0] | limits[1] | limits[2] | limits[3]


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept`` of every document.

    The reference is taken twice: the second time without documents far from the first.
    """
    counted = settle(features(docs, *keep), "counts")
    near = compared(counted, references(counted)).where(~F.col("far"))
    return compared(counted, references(near)).withColumn("kept", ~F.col("base_failed") & ~F.col("far")).drop("far")
