"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waystone.llm import decontaminate, jaccard, language, licenses, line_frequency, packing, ppm, quality_model, queries, substrings, toxicity

LONG = "lorem ipsum dolor " * 9000
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (None, "one two three four five six", "fr", "a", 1),
    (3, "", "en", None, 0),
    (4, " \t\n", None, "b", 3),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x" * 200_000, "de", "b", 200_000),
    (7, "ünï 日本\x00   end", "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "n_words", "matches", "kept", "component_id", "n_shingles", "labels", "places", "lang_pred", "start", "ids", "factors", "_text", "_set", "_chunk", "_label", "base_score", "n_hit", "focus", "_host", "_lines", "_matches", "_n_words", "_n_hit", "_words", "_keys", "_hashes", "_places", "_trained", "_counts", "own", "key", "host", "_own", "own_text", "_bits", "_row"]


def tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (77, 1, 0)] if rows else [], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "one two three four five six"), (None, "lorem ipsum dolor"), (1, None), (2, "")] if rows else [], "item_id long, text string")
    return docs, labels, bench


OPERATORS = {
    "decontaminate": lambda d, l, b: decontaminate.find_contamination(d, b),
    "jaccard": lambda d, l, b: jaccard.near_copies(d),
    "lines": lambda d, l, b: line_frequency.judge_lines(d),
    "quality": lambda d, l, b: quality_model.score_quality(d, quality_model.fit(d, l)),
    "licenses": lambda d, l, b: licenses.scan_licenses(d),
    "toxicity": lambda d, l, b: toxicity.score_toxicity(d, toxicity.fit(d, l)),
    "language": lambda d, l, b: language.identify(d, language.fit(d, F.col("doc_id") % 2 < 2)),
    "packing": lambda d, l, b: packing.pack_sequences(d, queries.tokenizer()),
    "substrings": lambda d, l, b: substrings.remove_repeats(d),
    "ppm": lambda d, l, b: ppm.score_texts(d, F.col("doc_id") > 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](*tables(spark, ROWS)).collect()
    if name != "packing":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    else:
        assert {r.doc_id for r in got} == {r[0] for r in ROWS}


#: What rows 2 (null), 3 (empty) and 4 (white space) give.
BARE = {
    "decontaminate": lambda r: (r.n_words, r.n_hit, r.matches) == (0, 0, []),
    "jaccard": lambda r: (r.n_shingles, r.component_id) == (0, r.doc_id),
    "lines": lambda r: (r.n_words, r.word_chars, r.n_repeat_words, r.n_left, r.base_failed, r.kept) == (0, 0, 0, 0, True, False),
    "licenses": lambda r: (r.n_words, r.places, r.base_labels, r.labels, r.score) == (0, [], "", "", 0.5),
    "language": lambda r: (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False),
    "substrings": lambda r: (r.n_words, r.n_removed, r.kept_text, r.factors) == (0, 0, "", []),
    "ppm": lambda r: r.n_tokens == 1 and r.score < 0,
    "quality": lambda r: 0 <= r.score <= 1 and r.focus == 0,
    "toxicity": lambda r: 0 <= r.score <= 1,
}


@pytest.mark.parametrize("name", BARE)
def test_texts_without_words(spark, name):
    got = {r.doc_id: r for r in OPERATORS[name](*tables(spark, ROWS)).collect() if r.doc_id in (2, 3, 4)}
    assert all(BARE[name](r) for r in got.values()), got
    if "score" in got[2]:
        assert got[2].score == got[3].score


def test_null_ids_and_repeated_rows(spark):
    d, labels, bench = tables(spark, ROWS)
    same = [r for r in jaccard.near_copies(d).collect() if r.doc_id in (1, None)]
    assert [(r.doc_id, r.component_id) for r in sorted(same, key=str)] == [(1, 1), (1, 1), (None, 1)]
    assert {r.doc_id: r.n_hit for r in decontaminate.find_contamination(d, bench).collect() if r.doc_id in (1, None)} == {1: 6, None: 6}
    long = {r.doc_id: r for r in substrings.remove_repeats(d).collect()}[5]
    assert (long.n_words, long.n_removed) == (27000, 27000)


def test_ties(spark):
    """Equal passages: the first has the focus. Equal languages: the first by name. Equal documents: each is packed."""
    d = spark.createDataFrame([(i, " ".join(["same words again"] * 100), "ba"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert {r.focus for r in quality_model.score_quality(d.filter("doc_id = 1").withColumn("text", F.expr("substring(text, 1, 0)")), quality_model.fit(d, labels)).collect()} == {0}
    tool = language.fit(d, F.lit(True))
    assert {r.lang_pred for r in language.identify(d, tool).collect()} == {"a"}
    packed = packing.pack_sequences(d, queries.tokenizer()).collect()
    total = sum(r.length for r in packed)
    assert {r.doc_id for r in packed} == set(range(40)) and total == 40 * packed[0].doc_tokens and len({(r.doc_id, r.start) for r in packed}) == len(packed)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](*tables(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    docs, labels, bench = tables(spark, ROWS)
    plain = OPERATORS[name](docs, labels, bench)
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).select(F.create_map(F.lit("k"), "doc_id").alias("map"), "*")
    got = OPERATORS[name](docs, labels, bench)
    # the caller's columns come back with their values, but for those that the results take
    made = [c for c in plain.columns if c not in SCHEMA.replace(",", "").split()]
    for r in got.select("doc_id", "map", *[c for c in CLASHES if c not in made]).collect():
        assert r.map == {"k": r.doc_id} and all(r[c] == f"own {c}" for c in CLASHES if c not in made)
    assert len(got.columns) == len(set(got.columns))
    own = [c for c in plain.columns if c not in ("factors", "sequence_id", "offset")]
    a, b = (sorted(map(str, x.select(*own).collect())) for x in (plain, got))
    assert a == b or name == "packing" and len(a) == len(b)


def test_pipeline_on_odd_rows(spark, tmp_path):
    for kind, rows in (("some", ROWS), ("none", [])):
        d = f"file://{tmp_path}/{kind}"
        for name, t in zip(("documents", "labels", "benchmark"), tables(spark, rows), strict=True):
            t.write.parquet(f"{d}/{name}.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == columns
        left = corpus_pipeline.run(spark, d).collect()
        assert bool(left) == bool(rows)


def test_cut_repeats_keeps_clean_texts(spark):
    rows = [(1, "two  spaces\nand lines", "en", "a", 20), (2, " ".join(f"w{i}" for i in range(50)), "en", "a", 1), (3, "z " + " ".join(f"w{i}" for i in range(50)), "en", "a", 1)]
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got[1].text == rows[0][1] and got[2].text == "" and got[3].text == "z" and got[3].n_chars == 1


def test_substring_places_hold_whatever_order_a_shuffle_brings():
    """Each pass over a chunk may see its rows in another order: the words to remove stay the same."""
    import random

    import pyarrow as pa

    rng, window, n = random.Random(5), 35, 4
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) + (" " + passage if k % 3 == 0 else "") for k in range(9)] + ["", None]
    rows = lambda: pa.table({"_chunk": pa.array([0] * len(texts), pa.int32()), "_text": pa.array(rng.sample(texts, len(texts)))})
    by = lambda t, c: [((pa.scalar(k),), t.filter(pa.array([x == k for x in t[c].to_pylist()]))) for k in sorted(set(t[c].to_pylist()))]
    key = (pa.scalar(0),)
    answers = lambda t, f: pa.concat_tables([f(k, x) for k, x in by(t, "_block")])
    schema = pa.schema([("_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("block", pa.int32()), ("chunk", pa.int32()), ("position", pa.int64())])))])
    for _ in range(5):
        seeds = answers(substrings._seeds(window, n)(key, rows()), substrings._repeated)
        found = answers(substrings._sent(window, n)(key, seeds, rows()), substrings._factored(window))
        found = found.set_column(2, "_kind", pa.array([substrings.FACTORS] * found.num_rows, pa.int32()))
        out = substrings._removed(window, ["_text"], schema)(key, pa.concat_tables([seeds, found]), rows())
        assert {r["_text"]: r["n_removed"] for r in out.to_pylist()} == {t: 50 if t and passage in t else 0 for t in texts}
