"""The registered queries of the training-data operators: digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, fp_search, jaccard, language, licenses, line_frequency, packing, ppm, quality_model, substrings, toxicity
from .sampling import fold

TOKENIZER = "byte_bpe_50k.json"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge_lines(_table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("text", "source", "n_left", "kept_text")


def op4_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_model.score_quality(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.transform("places", lambda p: p["word"])
    return licenses.scan_licenses(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"), "base_labels", "labels", "score"
    )


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    tool = language.fit(docs, fold("doc_id", 3) != 1)
    return language.identify(docs.select("doc_id", "text"), tool).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted", "bits")


def op8_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score_texts(_table(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.best_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("known")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_ngram_jaccard, op3_line_frequency, op4_quality_attention, op5_license_scan, op6_toxicity_fm, op7_language_kn, op8_packing_nnls, op9_substring_rlz, op10_ppm)
} | {f.__name__: f for f in (op11_fp_tree_search, op12_source_divergence, op13_exact_dedup)}

_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

#: Window hits by joins on the windows' words.
_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOW.format("text")}, '{_W}'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("text")}, '{_W}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)"""

_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY r),
raw AS (SELECT r, host, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT r, host, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[^\p{L}0]+', ' ', 'g'), ' ') AS line FROM raw),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM lines WHERE line <> '' GROUP BY host, line) JOIN hosts USING (host) WHERE n >= 20 AND n > docs * CAST(0.05 AS DOUBLE)),
lost AS (SELECT r, sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM lines JOIN often USING (host, line) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed,
  NOT (len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w)) AND len(w) - coalesce(lost.n, 0) >= 0.5 * len(w) AS kept
FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)"""

_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + 34) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(g, ' '))) AS n FROM win) WHERE n > 1),
starts AS (SELECT r, list(i) AS s FROM again GROUP BY r),
gone AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM again)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

#: Every document with a term of an item is scored.
_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("text")}, '{_W}') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * n_docs + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS n_docs FROM tf GROUP BY term), s),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(regexp_extract_all({_LOW.format("text")}, '{_W}')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
m AS (SELECT r, doc_id, 25 + (75 * n * docs) // terms AS m FROM n, s),
scored AS (SELECT i, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: Every group is crossed with every term that its language keeps.
_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, {_LOW.format("coalesce(text, '')")} AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (g.n + 2 * v.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN v USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS norm FROM d)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM x WINDOW best AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST, r)"""

ORACLE_SQL: dict[str, str] = {"op1_decontamination": _OP1, "op3_line_frequency": _OP3, "op9_substring_rlz": _OP9, "op11_fp_tree_search": _OP11, "op12_source_divergence": _OP12, "op13_exact_dedup": _OP13}
