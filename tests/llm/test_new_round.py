"""FP-tree search, source divergence and exact deduplication: brute force, odd rows, ties, hot groups and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waystone.llm import divergence, exact_dedup, fp_search, line_frequency

LONG = "lorem ipsum dolor " * 9000
ROWS = [
    (1, "one two three four five six", "en", "a"),
    (1, "one two three four five six", "en", "a"),
    (2, None, None, None),
    (None, "one two  three four five six", "fr", "a"),
    (3, "", "en", None),
    (4, " \t\n\x0b\x0c\r", None, "b"),
    (5, LONG, "en", "b"),
    (6, "x" * 200_000, "de", "b"),
    (7, "ünï 日本\x00   end 42", "de", "c"),
    (8, "ÜNÏ 日本", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = {"keep_id": "1", "kept": "2", "id": "3", "old": "4", "digest": "5", "row": "6", "own": "7", "group": "8", "chars": "9", "rank": "10", "score": "11", "number": "12", "term": "13", "n": "14", "a": "15"}


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def made_up(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"{'wxyz'[k % 4]}{chr(97 + k % 26)}é{chr(97 + k // 26)}" for k in range(vocabulary)]
    rows = []
    for i in range(n):
        text = " ".join(words[min(int(rng.expovariate(0.08)), vocabulary - 1)] for _ in range(rng.randrange(1, 40)))
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice("abcd")))
    # a third of all rows are copies of one text of one source
    rows += [(n + i, rows[0][1], "en", "a") for i in range(n // 2)]
    return rows


def ranked(docs, items, top=10):
    """By the rule, document by document, in Python integers."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(word.findall(low(t)))) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        asked = Counter(word.findall(low(text)))
        found = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, k in asked.items() if t in b)
            if s > 0:
                found.append((-s, i is None, i))
        out.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:top], 1))
    return out


ITEMS = [(0, "one two three Four"), (None, "lorem ipsum dolor dolor"), (1, None), (2, ""), (3, "ünï 42"), (3, "ünï 42"), (4, "nowhere")]


def searched(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in fp_search.best_documents(d.repartition(3), b, **options).collect())


def test_search_on_odd_rows(spark):
    got = searched(spark, ROWS, ITEMS)
    assert got == ranked(ROWS, ITEMS)
    assert got[(3, 1, 7, max(k[3] for k in got if k[0] == 3))] == 2
    assert [k[2] for k in sorted((k for k in got if k[0] == 0), key=lambda k: k[1])] == [1, 1, None] and max(got.values()) == 2
    assert searched(spark, ROWS, [(9, LONG)]) == ranked(ROWS, [(9, LONG)])
    assert searched(spark, [], ITEMS) == searched(spark, ROWS, []) == Counter()


@pytest.mark.parametrize("query_bytes", [1 << 20, 200])
def test_search_equals_brute_force(spark, monkeypatch, query_bytes):
    """Copies of a third of all rows, ties, many items, several blocks of items and several trees in a task."""
    monkeypatch.setattr(fp_search, "TREE_ENTRIES", 900)
    docs = made_up(1, 300)
    items = [(k, t) for k, (_, t, *_) in enumerate(made_up(2, 20))]
    assert searched(spark, docs, items, query_bytes=query_bytes) == ranked(docs, items)


def test_tree_bounds_hold_and_prune():
    """No score below a node is above its bound; a selective query enters few nodes."""
    rng = np.random.default_rng(5)
    vectors = [np.unique(np.minimum(rng.exponential(12, rng.integers(1, 30)).astype(np.int64), 99)) for _ in range(3000)] + [np.arange(40)] * 900
    first = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    term, tf, m = np.concatenate(vectors), rng.integers(1, 9, first[-1]), rng.integers(25, 400, len(vectors))
    tree = fp_search.Tree(first, term, tf, m, 100)
    assert sorted(tree.order.tolist()) == list(range(len(vectors)))
    assert len(tree.levels) < 2 + math.log2(len(vectors))
    for _ in range(20):
        weight = np.zeros(100, np.int64)
        weight[rng.integers(0, 100, 4)] = rng.integers(1, 9000, 4)
        exact, bound = tree.scores(0, len(m), weight), tree.bounds(0, 1, weight)
        assert bound[0] >= exact.max()
        for k, (lo, hi) in enumerate(tree.ranges.tolist()):
            assert tree.bounds(k, k + 1, weight)[0] >= exact[lo:hi].max()
    seen = []
    whole = tree.scores
    tree.scores = lambda lo, hi, w: (seen.append(hi - lo), whole(lo, hi, w))[1]
    rare = np.zeros(100, np.int64)
    rare[[70, 5]] = [50_000, 10]
    q = fp_search.Queries(pa.array([0]), np.array([0, 2]), np.array([70, 5]), np.array([1, 1]), np.arange(100), np.arange(100), rare)
    best = fp_search.Best(1, 10)
    fp_search._visit(tree, list(range(len(m))), q, best, np.zeros(100, np.int64))
    exact = whole(0, len(m), rare)
    want = sorted((-s, False, i) for i, s in enumerate(exact.tolist()) if s)[:10]
    assert best.rows[0] == want and sum(seen) < len(m) / 2


def audited(rows, min_docs=10, top=10):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", word.findall(low(t))) for _, t, lang, source in rows]
    have, counts, groups = Counter(), Counter(), {(lang, source) for lang, source, _ in docs}
    for lang, source, w in docs:
        have.update((lang, t) for t in set(w))
        counts.update((lang, source, t) for t in w)
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in have.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        share = {}
        for s in [*sources, None]:
            c = {t: sum(counts[lang, y, t] for y in (sources if s is None else [s])) for t in kept}
            share[s] = {t: (n, 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept))) for t, n in c.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(share[s][t][1], share[o][t][1]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p, share[None][t][1]), t.encode()) for t, (n, p) in share[s].items() if n and p > share[None][t][1]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out.update((lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(some, 1))
    return out


@pytest.mark.parametrize(("rows", "least"), [(ROWS, 10), (ROWS, 1), (ROWS, 2), (made_up(3, 200), 10), (made_up(4, 40) + [(-1, None, "xx", "a"), (-2, "", "xx", "é"), (-3, "ab", "xx", "z")], 3), ([], 1)])
def test_divergence_equals_brute_force(spark, rows, least):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()})
    got = Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit_sources(d.repartition(3), min_docs=least).collect())
    assert got == audited(rows, least)


def test_shares_beyond_64_bits(spark):
    """10**9 times a count of 2**40 doesn't fit into 64 bits."""
    rows = [(2**40, 2**41, 3), (8_999_999_999, 10**10, 1), (9_000_000_000, 10**10, 1), (0, 0, 5)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.v) for r in got)


def copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    return Counter((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows), len(groups)


HISTORY = {"default": None, "none": "false", "all": "true", "null": "cast(null as boolean)", "some": "doc_id % 3 = 0"}


@pytest.mark.parametrize("history", HISTORY)
@pytest.mark.parametrize("rows", [ROWS, made_up(6, 4000), []], ids=["odd", "many", "empty"])
def test_exact_dedup_equals_brute_force(spark, history, rows):
    """The result is the same whatever part is history; a third of the rows are one text, above the limit of hot groups."""
    d = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.find_copies(d.repartition(3), history=HISTORY[history] and F.expr(HISTORY[history])).collect()
    want, groups = copies(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    stay = [r for r in got if r.kept]
    assert len(stay) == groups == len({r.text_sha256 for r in stay}) and all(r.doc_id == r.keep_id for r in stay)
    if history == "all":
        assert all(r.known for r in got)
    if history in ("none", "null"):
        assert not any(r.known for r in got)


def test_exact_dedup_keeps_columns(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()}).withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    got = exact_dedup.drop_copies(d)
    own = [c for c in d.columns if c not in exact_dedup.MADE]
    assert got.columns == own
    rows = got.collect()
    assert len(rows) == copies(ROWS)[1] and all(all(r[c] == v for c, v in CLASHES.items() if c in own) and r.m == {"k": r.doc_id} for r in rows)
    assert {r.text for r in rows} <= {t for _, t, *_ in ROWS} and {r.doc_id for r in rows} == {None, 4, 5, 6, 7, 8}


def test_perfect_hash():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, (30_000, 4)).astype(np.uint64)
    words[:100, :3] = 7  # apart in one word only
    tool = exact_dedup.PerfectHash.build(words)
    assert sorted(tool.slots(words).tolist()) == list(range(len(words)))
    other = tool.slots(rng.integers(0, 1 << 62, (1000, 4)).astype(np.uint64))
    assert other.min() >= -1 and other.max() < len(words) and len(tool.bits) < 5 * len(words)
    assert exact_dedup.PerfectHash.build(words[:0]).slots(words[:2]).tolist() == [-1, -1]


def test_lines_above_the_limits_are_removed(spark):
    """The kept text by a plain count of lines; digits, case and signs don't tell lines apart, hosts do."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        own = [f"line {rng.randrange(10**6):x} of its own" for _ in range(rng.randrange(0, 4))]
        shared = [rng.choice(["Share this! 12", "share THIS 7", "Home | About", "***", "", "Rare line"]) for _ in range(rng.randrange(0, 5))]
        rows.append((i, "\n".join(rng.sample(own + shared, len(own + shared))) if i % 17 else None, "en", "ab"[i % 3 == 0]))
    word = lambda x: re.sub(r"[^\W\d_]+|\d+", lambda m: "0" if m[0].isdigit() else m[0], x.lower())
    norm = lambda x: re.sub(r"[^a-z0]+", " ", word(x)).strip()
    docs = Counter(h for *_, h in rows)
    have = Counter((h, x) for _, t, _, h in rows for x in {norm(x) for x in (t or "").split("\n")} if x)
    above = {k for k, n in have.items() if n >= 20 and n > 0.05 * docs[k[0]]}
    got = {r.doc_id: r for r in line_frequency.judge_lines(spark.createDataFrame(rows, SCHEMA), min_words=1).collect()}
    for i, t, _, h in rows:
        left = [x for x in (t or "").split("\n") if (h, norm(x)) not in above]
        assert got[i].kept_text == "\n".join(left) and got[i].n_left == sum(len(x.split()) for x in left)
    assert len(above) >= 3 and any(r.kept_text != (r.text or "") for r in got.values())
