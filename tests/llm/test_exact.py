"""Operators against brute force on small texts, cut into several chunks."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waystone.llm import blocks, decontaminate, jaccard, language, licenses, line_frequency, packing, ppm, quality_model, substrings, toxicity
from waystone.llm.graph import components
from waystone.llm.queries import tokenizer

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def texts(seed=1, n=120):
    """Texts with copies, near copies, shared passages, odd spacing and words beyond ASCII."""
    rng = random.Random(seed)
    vocabulary = [rng.choice(["the", "of", "ßa", "éu", "日本", "x1"]) + "".join(rng.choice("abcde") for _ in range(rng.randint(0, 3))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 20, 80, 200]))]
        if i % 5 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10) :]
        if i % 7 == 3 and out:
            words = out[rng.randrange(len(out))].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", ", ", ".\t"]) for w in words))
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, ""), (902, " \n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_decontamination(spark, docs, rows):
    words = lambda t: ALNUM.findall((t or "").translate(LOW))
    sources = [t for _, t in rows if t and len(words(t)) > 30][:8]
    bench = [(k, " ".join(words(t)[3:40]).upper()) for k, t in enumerate(sources)] + [(50, "x1 the"), (51, None), (52, "..."), (53, " ".join(words(sources[0])[3:20]))]
    for block in (4_000_000, 20):
        got = {r.doc_id: r for r in decontaminate.find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), block_words=block).collect()}
        for i, t in rows:
            w, hit, items = words(t), set(), set()
            for k, b in bench:
                bw = words(b)
                n = min(13, len(bw))
                for j in range(len(bw) - n + 1 if n else 0):
                    for s in range(len(w) - n + 1):
                        if w[s : s + n] == bw[j : j + n]:
                            hit |= set(range(s, s + n))
                            items.add(str(k))
            assert (got[i].n_words, got[i].n_hit, {m.item_id for m in got[i].matches}) == (len(w), len(hit), items)


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q zz"), (2, "b c")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "qq b c d e f g h i j k l m n o p xx")], "item_id long, text string")
    got = {r.doc_id: r.matches for r in decontaminate.find_contamination(d, b).collect()}
    assert [(m.item_id, m.start, m.item_start, m.length) for m in got[1]] == [("7", 1, 1, 15)] and got[2] == []
    assert [r.doc_id for r in decontaminate.decontaminate(d, b).collect()] == [2]


def test_ngram_join(spark, docs, rows):
    for n, num in ((4, 85), (5, 80)):
        got = {r.doc_id: r for r in jaccard.near_copies(docs, n=n, num=num, at_once=2000, least=2, order_size=50).collect()}
        sets = {}
        for i, t in rows:
            w = WHITE.findall((t or "").translate(LOW))
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and len(sets[a] & sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}


def test_many_near_copies_in_tiles(spark, monkeypatch):
    """A large group whose members differ, in buckets that are cut into tiles."""
    monkeypatch.setattr(jaccard, "TILE", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    seen, todo = {}, sorted(sets)
    for i in todo:
        if i in seen:
            continue
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen[k] = i
                stack += [j for j in todo if j not in seen and 100 * len(sets[k] & sets[j]) >= 85 * len(sets[k] | sets[j])]
    assert got == seen


def test_one_of_each(spark):
    d = spark.createDataFrame([(5, "a b c d e"), (3, "A b  c d e"), (3, "a b c d e"), (9, "q r s t u"), (None, ""), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in jaccard.one_of_each(d).collect() if r.text)[0][0] == 3
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(d).collect()) == ["3", "4", "9", "None"]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    with blocks.Scratch(spark) as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long").repartition(5), scratch).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_substring_dedup(docs, rows):
    for window in (35, 9, 3):
        got = {r.doc_id: r for r in substrings.remove_repeats(docs, window=window, chunk_bytes=3000).collect()}
        words = {i: WHITE.findall(t or "") for i, t in rows}
        n = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
        for i, w in words.items():
            gone = {j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
            assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
            if window > 8:
                assert {j for f in got[i].factors for j in range(f.start, f.start + f.length)} == gone


def test_ppm_and_counts(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {r.doc_id: r for r in ppm.score_texts(docs, F.expr("crc32(cast(doc_id as string)) % 7 <> 2"), chunk_bytes=4000).collect()}
    counts, seen = Counter(), [{} for _ in range(5)]
    for i, t in rows:
        if held(i):
            continue
        counts.update(WHITE.findall((t or "").translate(LOW)) + [None])
        b = b"\0" * 4 + (t or "").encode() + b"\0"
        for k in range(5):
            for j in range(4, len(b)):
                c = seen[k].setdefault(b[j - k : j], Counter())
                c[b[j]] += 1
    total, types = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = WHITE.findall((t or "").translate(LOW)) + [None]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)
        assert got[i].base_score == pytest.approx(base, abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        b, score = b"\0" * 4 + (t or "").encode() + b"\0", 0.0
        for j in range(4, len(b)):
            out = set()
            for k in range(4, -1, -1):
                c = {s: n for s, n in seen[k].get(b[j - k : j], {}).items() if s not in out}
                if not seen[k].get(b[j - k : j]):
                    continue
                n, q = sum(c.values()), len(c)
                if b[j] in c:
                    score += math.log10(c[b[j]] / (n + q))
                    break
                if n + q:
                    score += math.log10(q / (n + q))
                out |= set(seen[k][b[j - k : j]])
            else:
                score -= math.log10(256 - len(out))
        assert got[i].score == pytest.approx(score, rel=1e-5)


def test_line_rules(spark, docs, rows):
    common = "Home | About"
    more = [(1000 + i, f"{common}\n{'word ' * 60}{chr(97 + i % 26) * (1 + i // 26)}\n{common}", "h") for i in range(30)] + [(2000 + i, "\n".join([common] * 40 + [f"one {i}"]), "h") for i in range(5)] + [(3000, None, None)]
    d = docs.withColumn("source", F.lit("a")).unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    got = {r.doc_id: r for r in line_frequency.judge_lines(d).collect()}
    for i, t, *_ in rows + more:
        w, t = WHITE.findall(t or ""), t or ""
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if WHITE.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    # the common line is on all 35 documents of its host; only those that it makes up are depleted
    assert got[1000].n_left == got[1000].n_words - 6 and not got[2000].kept and got[2000].n_left == 2
    assert not got[3000].kept


def test_jaccard_looks_behind_the_nearest_bitmap(spark):
    """The first of three sets has the bitmap of the second, which it is no copy of; only its pair with the third is a link."""
    from waystone.llm import textarrays as T

    def sets(lines):
        import pyarrow as pa

        return jaccard.Sets(*T.utf8(pa.array(lines)), 1)

    pool = [f"w{i}" for i in range(12_000)]
    one = sets(pool)
    token, bit = dict(zip(pool, one.token.tolist(), strict=True)), dict(zip(pool, np.unpackbits(jaccard.bitmaps(one).view(np.uint8), axis=1).argmax(1).tolist(), strict=True))
    for seed in range(50):
        rng = random.Random(seed)
        a = sorted(rng.sample(pool, 100), key=token.get)
        rest = [w for w in pool if w not in a and token[w] > token[a[30]]]
        decoy, copy = list(a), list(a)
        for k in range(40, 60):
            decoy[k] = next(w for w in rest if bit[w] == bit[a[k]] and w not in decoy)
        for k in range(90, 95):
            copy[k] = next(w for w in rest if w not in decoy + copy and bit[w] not in {bit[x] for x in [*a, *copy]})
        rows = list(enumerate(map(" ".join, (decoy, a, copy))))
        s = sets([t for _, t in rows])
        gap = np.bitwise_count(jaccard.bitmaps(s)[0] ^ jaccard.bitmaps(s)).sum(1).tolist()
        if s.name.argmin() == 0:
            break
    assert s.name.argmin() == 0 and gap == [0, 0, 10]
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), n=1, num=80, den=100).collect()
    words = [set(t.split()) for _, t in rows]
    want = {(i, j) for i in range(3) for j in range(i) if 100 * len(words[i] & words[j]) >= 80 * len(words[i] | words[j])}
    assert want == {(2, 1)} and {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 1}


def test_line_frequency_on_a_text_above_a_million_words(spark):
    w = [f"{i:x}" for i in range((1 << 20) + 300)]
    w[5:9] = w[(1 << 20) + 100 : (1 << 20) + 104] = ["p", "q", "r", "s"]
    d = spark.createDataFrame([(1, " ".join(w), "h"), (2, "a b c d", "h")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_repeat_words for r in line_frequency.judge_lines(d).collect()} == {1: 8, 2: 0}


def test_one_of_each_keeps_one_row_of_each_component(spark):
    """Null ids, one id of several texts, and repeated rows."""
    name = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(None, name("a")), (None, name("b")), (None, name("b")), (1, name("b") + " x"), (5, name("c")), (5, name("d")), (5, name("d")), (5, name("e")), (3, name("e")), (None, "")]
    got = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=5, num=80, den=100).collect()]
    assert sorted(got, key=str) == sorted([(None, name("a")), (1, name("b") + " x"), (5, name("c")), (5, name("d")), (3, name("e")), (None, "")], key=str)


def test_line_frequency_applies_the_share_before_collecting(spark):
    """A host's lines come together only after its share has been applied row by row."""
    d = spark.createDataFrame([(i, f"line {'abc'[i % 3]}\nall have it", "h") for i in range(90)], "doc_id long, text string, source string")
    got = line_frequency.judge_lines(d, min_docs=20, share=0.5)
    assert {r.n_left for r in got.collect()} == {2}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(plan) if "collect_list(" in x)
    assert "_line" in plan[at] and any("Join Inner" in x and "_docs" in x for x in plan[at + 1 :])


def test_line_frequency_keeps_unique_documents(spark):
    # letters, as all numbers count as one sign in a normalised line
    name = lambda i, k: f"w{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, f"{' '.join(name(i, k) for k in range(80))}\nshared footer", "h") for i in range(50)]
    assert all(r.kept for r in line_frequency.judge_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer())
    for window in (1024, 64):
        got = packing.pack_sequences(docs, tokenizer(), window=window).collect()
        ids = {i: tool.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
        parts, sequences = {}, {}
        for r in sorted(got, key=lambda r: r.start):
            parts.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        for i, want in ids.items():
            assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in parts[i]]).tolist() == want
            assert [r.start for r in parts[i]] == np.cumsum([0] + [r.length for r in parts[i]])[:-1].tolist() and parts[i][0].doc_tokens == len(want)
        padding = 0
        for s in sequences.values():
            s.sort(key=lambda r: r.offset)
            size = sum(r.length for r in s)
            assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist() and size <= window
            padding += 0 if size & (size - 1) == 0 else window - size
        assert padding == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tool, mine = Tokenizer.from_file(tokenizer()), packing.Encoder(tokenizer())
    assert mine.by_word
    odd = ["x 's don't a'b c,'d e's. f!?g h1 2i _j k_ (l) #m %%%n o%%% ÀÉp qß, ª µ º × ÷ ǀ ɏ ɐ", "u\xa0v w\u3000x y\x1cz a\x85b \u180e","", " ", "a ", " a", "a  b", "a\n b\t c", "x<|endoftext|>y z", "don't we'll", "１２ ٣ ½", "é b  c", "\r\n\r\n x", "日本 語"]
    for t in odd + texts(9, 40):
        assert np.frombuffer(mine.encode([t])[0], "<u4").tolist() == tool.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("kind", ["short", "even", "long tail"])
def test_nnls_plans_most_windows(kind):
    """Whatever the lengths, most tokens lie in windows that the combinations fill, with small gaps."""
    rng = np.random.default_rng(4)
    lengths = {"short": rng.integers(20, 300, 15_000), "even": rng.integers(1, 1024, 15_000), "long tail": np.minimum(rng.lognormal(5.5, 1, 15_000).astype(int) + 1, 1023)}[kind]
    windows, left = packing.plan(lengths, 1024)
    full = np.array([lengths[w].sum() for w in windows])
    assert sorted([i for w in windows for i in w] + left) == list(range(len(lengths)))
    assert full.max() <= 1024 and full.mean() > 0.95 * 1024 and full.sum() > 0.8 * lengths.sum()


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=20)
    x = packing.nnls(a, b)
    grad = a.T @ (a @ x - b)
    assert (x >= 0).all() and (grad > -1e-6).all() and abs(grad @ x) < 1e-6


def test_license_expressions():
    assert licenses.parse("MIT OR Apache-2.0 AND BSD-3-Clause */") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert licenses.parse("(MIT OR GPL-2.0-only) AND GPL-2.0-or-later WITH Classpath-exception-2.0") == ["MIT", "GPL-2.0-only", "or", "GPL-2.0-or-later", "Classpath-exception-2.0", "with", "and"]
    assert licenses.parse("OR MIT") is None and licenses.parse("(MIT") is None and licenses.parse("") is None
    assert licenses.evaluate(licenses.parse("MIT OR GPL-2.0-only")) == ({"mit", "gpl"}, 1.0)
    assert licenses.evaluate(licenses.parse("MIT AND GPL-2.0-only")) == ({"mit", "gpl"}, 0.0)


def test_license_scan(spark, docs, rows):
    more = [(1, "This is CC-BY. all rights\nRESERVED, all rights reserved"), (2, "// SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)\nx"), (3, "the GNU General Public License, cc by nc"), (4, None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert [(p.phrase, p.word) for p in got[1].places] == [("cc by", 2), ("all rights reserved", 4), ("all rights reserved", 7)]
    assert (got[1].base_labels, got[2].labels, got[2].score, got[3].labels) == ("cc-by,reserved", "gpl,mit", 1.0, "cc-by,cc-by-nc,gpl")
    assert (got[4].n_words, got[4].labels, got[4].places) == (0, "", [])
    for r in licenses.scan_licenses(docs).collect():
        assert r.n_words == len(ALNUM.findall((dict(rows)[r.doc_id] or "").translate(LOW)))


LABELLED = [(i, ("you idiot " if i % 3 == 0 else "") + " ".join(random.Random(i).choices(["sun", "tree", "walk", "river", "bread"], k=40)) + (" group" if i % 5 == 0 else "")) for i in range(600)]


def test_toxicity_learns(spark):
    d = spark.createDataFrame(LABELLED, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in LABELLED], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in got)
    assert {r.doc_id for r in toxicity.drop_toxic(d, labels).collect()} == {i for i in got if i % 3}


def test_factorization_machine_learns_pairs_through_fit(spark):
    """Two terms that are harmless alone and toxic when just one of them stands, among others: no additive weights and no
    selection of terms by their own association could tell."""
    rng = np.random.default_rng(5)
    rows, toxic = [], {}
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        words = [f"w{k}" for k in rng.choice(2000, 30, replace=False)] + ["qa"] * bool(a) + ["qb"] * bool(b)
        rows.append((i, " ".join(words)))
        toxic[i] = int(a != b)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(toxic[i]) for i in held]) > 0.98


def test_factorization_machine_gradient():
    rng = np.random.default_rng(1)
    col = np.concatenate([np.sort(rng.choice(6, 3, replace=False)) for _ in range(20)])
    x = toxicity.Sparse(np.repeat(np.arange(20), 3), col, rng.random(6).astype(np.float32), rng.random(6).astype(np.float32), 20)
    y, square = rng.integers(0, 2, 20).astype(np.float32), np.full(7 + 6 * toxicity.FACTORS, 0.3, np.float32)
    machine = toxicity.Machine([np.array([1], np.int32)], np.array([1]))
    theta = rng.normal(0, 0.5, len(square)).astype(np.float32)
    loss = lambda t: machine._loss(x, y, square, t)[0]
    grad = machine._loss(x, y, square, theta)[1]
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-2
        assert (loss(theta + step) - loss(theta - step)) / 2e-2 == pytest.approx(grad[k], rel=2e-2, abs=5e-3)


def test_quality_learns(spark):
    good = lambda r: " ".join(r.choices(["The", "river", "runs", "by", "old", "trees,", "and", "birds", "sing."], k=150))
    rows = [(i, good(random.Random(i)) if i % 2 else good(random.Random(i))[:200] + " " + " ".join(["BUY!!", "$$$", "&&&x"] * 40)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit(d, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    got = quality_model.score_quality(d, model).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(12, quality_model.WIDTH)), np.array([0, 3, 7, 12]), np.array([1.0, 0.0, 1.0])
    m = quality_model.Model(x, first, np.zeros(3))
    m.theta = [rng.normal(0, 0.3, p.shape) for p in m.theta]
    loss = lambda: -np.log(np.where(y == 1, (p := m._forward(x, first)[-1]), 1 - p)).mean()
    before = loss()
    m._fit(x, first, y, rng, epochs=5, batch=3, rate=0.01)
    assert loss() < before


def test_language(spark):
    pools = {"en": ["the", "river", "house", "through", "with"], "fr": ["été", "rivière", "maison", "avec", "où"], "de": ["über", "fluß", "haus", "durch", "mit"]}
    rows = [(i, " ".join(random.Random(i).choices(pools[k], k=30)), k) for i, k in enumerate(sorted(pools) * 60)] + [(900, None, "en"), (901, "12 — 3", "en"), (902, "", None), (903, "日本語の文章です", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tool = language.fit(d, F.col("doc_id") % 3 != 9)
    got = {r.doc_id: r for r in language.identify(d, tool).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:180])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred != "und" and not got[903].accepted


def test_kneser_ney_sums_to_one():
    words = "abab abba baba äb".encode()
    import pyarrow as pa

    from waystone.llm import textarrays as T

    buf, offsets = T.utf8(pa.array([words.decode()]))
    w = T.words_of(buf, offsets, T.NOT_ALNUM)
    gram, _, n = language.distinct_grams(language.word_grams(buf, w, np.arange(len(w)))[0])
    model = language.Counts(gram, n.astype(float))
    letters = np.array(sorted({*gram[:, -1].tolist()}))
    for context in (gram[0, :-1], np.array([0x61, 0x62, 0x61, 0x62])):
        p = lambda last: 2 ** model.log2(*language.hashed(np.concatenate([np.tile(context, (len(last), 1)), last[:, None]], 1)))  # noqa: B023, E731
        assert p(letters).sum() + (0x110000 - len(letters)) * p(np.array([0x10FFFF]))[0] == pytest.approx(1, abs=1e-4)


def test_language_models_are_over_characters():
    """Grams hold whole characters, whatever number of bytes they have."""
    import pyarrow as pa

    from waystone.llm import textarrays as T

    text = "日本語 été x𝄞"
    buf, offsets = T.utf8(pa.array([text]))
    w = T.words_of(buf, offsets, T.NOT_ALNUM)
    gram, first = language.word_grams(buf, w, np.arange(len(w)))
    assert first.tolist() == [0, 4, 8, 11]
    assert ["".join(map(chr, g)) for g in gram] == ["    日", "   日本", "  日本語", " 日本語 ", "    é", "   ét", "  été", " été ", "    x", "   x𝄞", "  x𝄞 "]


def test_prefixes_bound_what_two_sets_share(spark):
    """No similar pair is dropped, keys that coincide included, and pairs that share a passage only are."""
    rng = random.Random(11)
    rows, similar = [], []
    for k in range(400):
        n = rng.choice([1, 2, 9, 40, 300])
        a = set(rng.sample(range(1, 4000), n))
        kept = set(rng.sample(sorted(a), max(1, round(n * rng.choice([0.1, 0.5, 0.85, 0.9, 1])))))
        b = kept | set(rng.sample(range(4000, 8000), rng.randint(0, max(1, n // 10))))
        coarse = rng.choice([1, 3])  # several tokens with one key
        cut = [sorted(v % 4000 // coarse for v in sorted(s, key=lambda v: v % 4000 // coarse)[: len(s) + (85 * len(s)) // -100 + 1]) for s in (a, b)]
        rows.append((k, *cut, len(a), len(b)))
        similar.append(100 * len(a & b) >= 85 * len(a | b))
    d = spark.createDataFrame(rows, "k int, a array<int>, b array<int>, n_a int, n_b int")
    got = {r.k for r in d.filter(jaccard.may_link(F.col("a"), F.col("b"), F.col("n_a"), F.col("n_b"), 85, 100)).collect()}
    assert {k for k, s in enumerate(similar) if s} <= got
    far = {k for k, s in enumerate(similar) if not s}
    assert len(far) > 50 and len(got & far) < len(far) / 2


def test_wide_bitmaps_leave_no_large_unlike_pairs(spark):
    """Large sets pass the bitmaps of 512 bits whatever they hold; the wide ones stop unlike pairs and no similar one."""
    import pyarrow as pa

    from waystone.llm import textarrays as T

    rng = random.Random(11)
    base = [f"w{i}" for i in range(2400)]
    shared = [2400, 2385, 2220, 1950, 1200, 150, 0] * 2
    pairs = [(base, rng.sample(base, s) + [f"x{k}_{i}" for i in range(2400 - s if k % 2 else (2400 - s) // 2 + 700)]) for k, s in enumerate(shared)]
    pairs += [(base[:2100], base[:2040]), (base[:2100], base[:500]), (base[:520], base[:500])]  # two widths, and none
    one = lambda c: jaccard.Sets(*T.utf8(pa.array([" ".join(p[c]) for p in pairs])), 1)
    a, b = one(0), one(1)
    wide = [[w[e0:e1].view(np.int64).tolist() for e0, e1 in zip(ends, ends[1:], strict=False)] for w, ends in map(jaccard.wide_bitmaps, (a, b))]
    assert {len(x) for w in wide for x in w} >= {0, 32, 64}
    rows = [(k, wide[0][k], wide[1][k], int(a.size[k]), int(b.size[k])) for k in range(len(pairs))]
    d = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>, n_a int, n_b int")
    got = {r.k for r in d.filter(jaccard.near_bits(F.col("a"), F.col("b"), F.col("n_a"), F.col("n_b"), 85, 100)).collect()}
    alike = {k for k, (x, y) in enumerate(pairs) if 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y})}
    narrow = np.bitwise_count(jaccard.bitmaps(a) ^ jaccard.bitmaps(b)).sum(1)
    passed = {k for k in range(14) if 185 * narrow[k] <= 15 * (a.size[k] + b.size[k])}
    assert alike <= got and {14, 16} <= alike
    unlike = {k for k in range(14) if shared[k] <= 1200}
    assert unlike <= passed and not unlike & got  # the narrow bitmaps let all of them pass
