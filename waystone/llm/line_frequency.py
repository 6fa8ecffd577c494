"""Quality rules with line frequency across documents: DataFrame functions only.

Lines are normalised (lower case, runs of digits as 0, other signs as one space) and hashed. The number of documents of
a host that have a line is counted; lines above the limits are removed, and a document that loses too much is rejected.
Counting is one aggregation with partial sums, so a hot host or a hot line is summed up before it is shuffled. What
comes back to the documents is only the list of lines above the limits: at most (lines per document) / share for a host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = r"[ \t-\r]+"


def words(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _normalised(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), r"[^\p{L}0]+", " "))


def base_measures(docs: DataFrame, text: str, window: int = 3) -> DataFrame:
    """Adds _n_words, _word_chars, _n_symbols, _n_dup_lines and _n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_words", words(body))
    n = F.size("_words")
    full = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))
    # a hash of each window and its place, sorted, so equal windows become neighbours
    docs = docs.withColumn("_n_words", n.cast("bigint"))
    docs = docs.withColumn("_hashes", F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("_keys", F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def met(k, i):
        same = lambda other: F.coalesce(k["h"] == F.get("_keys", other)["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    docs = docs.withColumn("_places", F.sort_array(F.transform(F.filter("_keys", met), lambda k: k["i"])))
    # each repeated window covers its words up to the next one's start
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_places", i + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x
    )
    return docs.select(
        "*",
        F.length(F.regexp_replace(body, _SPACE, "")).cast("bigint").alias("_word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("bigint").alias("_n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("bigint").alias("_n_dup_lines"),
        covered.cast("bigint").alias("_n_repeat_words"),
    ).drop("_words", "_hashes", "_keys", "_places")


def _lines(text: str):
    """(hash of the normalised line, its words) of each line that has letters or digits."""
    kept = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(_normalised(x).alias("line"), x.alias("raw"))), lambda x: x["line"] != "")
    return F.transform(kept, lambda x: F.struct(F.xxhash64(x["line"]).alias("line"), F.size(words(x["raw"])).alias("n")))


@B.keeps_columns(*MADE, "base_failed", "n_left", "kept", "kept_text", roles=("text", "host"))
def judge_lines(docs: DataFrame, *, text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.05, least_left: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left, kept_text and kept.

    A line is above the limits on its host if it is in `min_docs` documents or more and in more than `share` of the
    host's. `kept_text` has the other lines, in order
    and as they were, also of documents that are rejected; `n_left` counts its words. A document is kept if the base rules hold (`min_words` words;
    at most `max_repeat` percent of words in 3-word windows that repeat) and `least_left` of its words are left.

    Null text has no words and keeps an empty text. Lines without letters and digits are never above the limits. Rows without a host are one host. A line twice in a document counts once; repeated rows
    are documents of their own. Texts are taken whole; windows are told apart by their 64-bit hashes.
    Columns of docs with the names of the results give way.
    """
    own = docs.columns
    key = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host")
    lines = docs.select(key, F.array_distinct(F.transform(_lines(text), lambda x: x["line"])).alias("_l"))
    counts = lines.select("_host", F.explode("_l").alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_docs)
    hosts = docs.select(key).groupBy("_host").agg(F.count("*").alias("_docs"))
    # the share holds row by row, before a host's lines come together: what is left is bounded
    above = counts.join(hosts, "_host").filter(F.col("_n") > F.col("_docs") * share).groupBy("_host").agg(F.collect_list("_line").alias("_above"))
    measured = base_measures(docs.withColumn("_host", key).withColumn("_lines", _lines(text)), text).drop(*([text] if text not in own else []))
    joined = measured.join(above, "_host", "left")
    lost = F.aggregate(F.filter("_lines", lambda x: F.array_contains(F.coalesce("_above", F.array().cast("array<bigint>")), x["line"])), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    above_limits = F.coalesce("_above", F.array().cast("array<bigint>"))
    kept_lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: ~F.array_contains(above_limits, F.xxhash64(_normalised(x))) | (_normalised(x) == ""))
    failed = (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat * F.col("_n_words"))
    left = F.col("_n_words") - lost
    return joined.select(*[f"`{c}`" for c in own], *[F.col(f"_{c}").alias(c) for c in MADE], failed.alias("base_failed"), left.alias("n_left"), F.array_join(kept_lines, "\n").alias("kept_text"), (~failed & (left >= least_left * F.col("_n_words"))).alias("kept"))
