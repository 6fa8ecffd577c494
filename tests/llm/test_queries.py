"""The registered queries on the given tables: against SQL in DuckDB, brute force and held-out labels."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from waystone.llm import decontaminate, jaccard, packing, queries, substrings, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = {
    "op1_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op3_line_frequency": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_quality_attention": ["doc_id", "held_out", "score", "predicted"],
    "op5_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_toxicity_fm": ["doc_id", "held_out", "score", "predicted"],
    "op7_language_kn": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_packing_nnls": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_substring_rlz": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_ppm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op13_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def duck(folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", COLUMNS)
def test_every_query_gives_its_columns(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    assert [c for c in got.columns if c in COLUMNS[name]] == COLUMNS[name]
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toArrow()
    want = duck(SMALL).sql(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    bag = lambda t: Counter(zip(*(t[c].to_pylist() for c in sorted(t.column_names)), strict=True))
    assert bag(got) == bag(want)


#: Base columns of the licence scan by plain SQL over words.
LICENSES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) t(phrase, label)),
h AS (SELECT r, i, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN p ON list_slice(w, i, i + len(phrase) - 1) = phrase)
SELECT d.doc_id, len(w) AS n_words, count(i) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN h USING (r) GROUP BY d.r, d.doc_id, w"""


def test_license_base_columns_equal_sql(spark):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = Counter(map(tuple, queries.op5_license_scan(spark, MIDDLE).select(*names).collect()))
    want = Counter(duck(MIDDLE).sql(LICENSES).select(*names).fetchall())
    assert got == want and sum(n for k, n in got.items() if k[2]) > 10


def labels(label):
    return dict(duck(MIDDLE).sql(f"SELECT doc_id, max({label}) FROM labels WHERE {label} IS NOT NULL GROUP BY doc_id").fetchall())


@pytest.mark.parametrize(("name", "label", "limit", "least"), [("op4_quality_attention", "quality", 0.3, 0.9), ("op6_toxicity_fm", "toxic", 0.5, 0.9)])
def test_classifiers_on_held_out_labels(spark, name, label, limit, least):
    truth = labels(label)
    got = queries.QUERIES[name](spark, MIDDLE).collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= limit) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    one, none = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(held) > 20 and np.mean([(a > b) + (a == b) / 2 for a in one for b in none]) > least


def test_languages_on_held_out_documents(spark):
    lang = dict(duck(MIDDLE).sql("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op7_language_kn(spark, MIDDLE).collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and np.mean([r.accepted for r in held]) > 0.9


def test_copies_of_every_fiftieth_document(spark):
    """Recall of the join: all rows whose id is divisible by 50 against all rows."""
    rows = duck(MIDDLE).sql("SELECT doc_id, text FROM documents").fetchall()
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {r.doc_id: r.component_id for r in queries.op2_ngram_jaccard(spark, MIDDLE).collect()}
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert all(root[a] == root[b] for a, b in links)


def test_pipeline_stages_by_their_operators(spark, tmp_path):
    """Each stage against a plain statement of its rule, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    name = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    for stage, run in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(run(spark, docs, SMALL).toArrow())
        before, after = docs.collect(), kept.collect()
        assert kept.columns == docs.columns
        if stage == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert name(after) == name(r for r in toxicity.score_toxicity(docs, model).collect() if r.score < 0.5)
        elif stage == "ngram_jaccard":
            roots = {(r.doc_id): r.component_id for r in jaccard.near_copies(docs, n=5, num=80).collect()}
            blank = [r for r in before if not (r.text or "").strip(" \t\n\v\f\r")]
            assert Counter(r.doc_id for r in after) == Counter([*{roots[r.doc_id] for r in before if r not in blank}, *(r.doc_id for r in blank)])
        elif stage == "substring_dedup":
            cut = {r.doc_id: r for r in substrings.remove_repeats(docs.select("doc_id", "text")).collect()}
            assert name(after) == Counter((r.doc_id, cut[r.doc_id].kept_text if cut[r.doc_id].n_removed else r.text) for r in before)
        else:
            found = decontaminate.find_contamination(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()
            assert name(after) == name(r for r in found if not (r.n_hit and 20 * r.n_hit >= r.n_words))
        docs = kept
    tool = packing.Encoder(queries.tokenizer())
    parts = {}
    for r in sorted(corpus_pipeline.packed(spark, docs, SMALL).collect(), key=lambda r: r.start):
        parts.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), "<u4"))
    for r in docs.collect():
        assert np.concatenate(parts[r.doc_id]).tolist() == tool.whole.encode(r.text or "", add_special_tokens=False).ids + [0]


def test_texts_above_a_chunk(spark):
    """Texts longer than chunks, shards and pieces: one passage in two of them, and one that repeats its own."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"{x:x}" for x in rng.integers(0, 1 << 40, n)]
    passage = words(60)
    a, b = words(500_000), words(20)
    a[250_000:250_000] = passage
    b[10:10] = passage
    c = words(400) + passage[:40] + words(10)
    d = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(words(40) * 2))], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(d).collect()}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {1: (500_060, 60), 2: (80, 60), 3: (450, 40), 4: (80, 80)}
    # factors refer to another place where the words stand
    assert all(f.length >= 35 for r in got.values() for f in r.factors) and got[2].factors
    bench = spark.createDataFrame([(7, " ".join(passage[5:30]))], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.find_contamination(d, bench).collect()}
    assert hit == {1: 25, 2: 25, 3: 25, 4: 0}
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(d.union(d.filter("doc_id = 1").selectExpr("9", "concat(text, ' x')"))).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 9: 1}
