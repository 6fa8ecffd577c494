"""Source divergence audit: which terms set a source apart within its language, and how far sources are from each other.

Terms are counted once, by (language, source, term). After that nothing is evaluated term by term: terms of one source with
the same (count there, count in the language) are one cell with a multiplicity, the score is evaluated for each cell, equal values are merged,
ranked by cumulative multiplicity, and only the cells that reach the report are expanded into terms, in UTF-8 order.

The distance of two sources sums the score over all kept terms. It is written as the value for terms that neither has,
corrected by the cells of each source (count, 0) and by the terms that both have. Those come from a join on the term and are summed up
by pair of sources where they are made; the result itself has one row for each ordered pair of a language's sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T

#: Text that is counted at once in a task.
PIECE_BYTES = 8 << 20
#: True for `[\x00-\x40\x5B-\x60\x7B-\x7F]`, to be used on lower-cased bytes.
NOT_ALPHA = np.zeros(256, bool)
NOT_ALPHA[0:128] = True
NOT_ALPHA[97:123] = False
COUNTS = "lang string, source string, term string, docs bigint, n bigint"


def _counted(lang: pa.Array, source: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
    words = T.words_of(buf, offsets, NOT_ALPHA)
    if not len(words):
        return None
    l, s = (x.dictionary_encode() for x in (lang, source))
    group = l.indices.to_numpy().astype(np.uint64) * np.uint64(len(s.dictionary)) + s.indices.to_numpy().astype(np.uint64)
    doc = words.owner()
    # a group's number spreads over all bits, so one stable sort brings a group's equal terms together, document by document
    key = T.word_hashes(buf, words) ^ T.mix(group + np.uint64(1))[doc]
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_doc = key[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= sorted_doc[1:] != sorted_doc[:-1]
    first = order[at]
    size = words.end[first] - words.start[first]
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(words.start[first] - ends[:-1], size) + np.arange(ends[-1])
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[place]))).cast(pa.string())
    owner = pa.array(doc[first])
    return pa.RecordBatch.from_arrays(
        [lang.take(owner), source.take(owner), terms, pa.array(np.add.reduceat(other, at).astype(np.int64)), pa.array(np.diff(np.append(at, len(order))).astype(np.int64))],
        ["lang", "source", "term", "docs", "n"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = T.utf8(batch.column("text"))
        lang, source = (batch.column(c).cast(pa.string()) for c in ("lang", "source"))
        for a, b in T.pieces(offsets, PIECE_BYTES):
            part = T.LOWER[buf[offsets[a] : offsets[b]]]
            got = _counted(lang.slice(a, b - a), source.slice(a, b - a), part, offsets[a : b + 1] - offsets[a])
            if got is not None:
                yield got


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), exact; 0 where a language keeps no term."""
    small = f"({count} + 2) * 1000000000 div ({total} + 2 * {terms})"
    large = f"(cast({count} + 2 as decimal(20, 0)) * 1000000000) div cast({total} + 2 * {terms} as decimal(20, 0))"
    # 10**9 times a count below 9 * 10**9 fits into 64 bits
    return F.expr(f"case when {terms} = 0 then 0L when {count} < 9000000000 then 1L + {small} else 1L + {large} end")


def apart(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square fits."""
    return F.expr(f"case when {p} + {q} = 0 then 0L else (({p} - {q}) * ({p} - {q})) div ({p} + {q}) end")


def _top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = kept.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("terms"))
    cells = cells.join(groups, ["lang", "source"]).withColumns({"p": share("n", "group_n", "v"), "q": share("total", "lang_n", "v")}).filter("p > q").withColumn("value", apart("p", "q"))
    cells = cells.select("lang", "source", "n", "total", "terms", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # each value has a term, so only the first `top` values can be reached
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("k", F.row_number().over(by_value)).filter(F.col("k") <= top)
    before = F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms")
    reached = values.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value")
    found = kept.join(cells.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "total", "value"), ["lang", "source", "n", "total"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.withColumn("p0", share("0L", "group_n", "v"))
    a, b = (g.select("lang", F.col("source").alias(x), F.col("group_n").alias(f"n_{x}"), F.col("p0").alias(f"p0_{x}"), *(["v"] if x == "a" else [])) for x in "ab")
    pairs = a.join(b, "lang").filter("a < b").withColumn("none", apart("p0_a", "p0_b"))
    parts = [pairs.select("lang", "a", "b", (F.col("v") * F.col("none")).alias("value"))]
    cells = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    for x, y in ("ab", "ba"):
        one = cells.withColumnRenamed("source", x).join(pairs, ["lang", x]).withColumn("p", share("n", f"n_{x}", "v"))
        parts.append(one.select("lang", "a", "b", (F.col("terms") * (apart("p", f"p0_{y}") - F.col("none"))).alias("value")))
    shares = kept.join(g, ["lang", "source"]).withColumn("p", share("n", "group_n", "v"))
    x, y = (shares.select("lang", "term", F.col("source").alias(c), F.col("p").alias(f"p_{c}"), F.col("p0").alias(f"p0_{c}")) for c in "ab")
    both = apart("p_a", "p_b") - apart("p_a", "p0_b") - apart("p_b", "p0_a") + apart("p0_a", "p0_b")
    parts.append(x.join(y, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(both).alias("value")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = out.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    out = out.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit_sources(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part `term`, the `top` terms of each source that stand out in its language, and part `pair`, every other source by distance.

    A language keeps the terms that `min_docs` of its documents have. A source's share of a term is smoothed by 2; a
    term stands out if the share is above the language's. Equal values rank by their names in UTF-8 order. All arithmetic is exact.

    Null text, lang and source read as ''. A group without kept terms has pairs, but no terms; a language without kept
    terms has distances of 0; a language with one source has no pairs. Repeated rows are documents of their own; no
    document is cut. An empty table has no groups. Other columns of docs are not read.
    """
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    with B.Scratch(docs.sparkSession) as s:
        counts = read.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        everywhere = Window.partitionBy("lang", "term")
        first = (F.col("source") == F.min("source").over(everywhere)).cast("int").alias("first")
        kept = counts.select("*", F.sum("docs").over(everywhere).alias("lang_docs"), F.sum("n").over(everywhere).alias("total"), first)
        kept = s.written(kept.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"))
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.sum("first").alias("v"))
        groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["group_n", "v"])
        # sums of a few rows for each source
        groups = s.written(groups)
        langs = groups.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.sum("v").alias("v"))
        groups = groups.drop("v").join(langs, "lang")
        return B.written(_top_terms(kept, groups, top).unionByName(_pairs(kept, groups)))
