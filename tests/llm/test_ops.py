"""Each operator against a plain version of itself, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinstrata.llm import bpe, exact_dedup, jaccard_join, language_id, license_scan, packing, scaled_sketch, secrets, suffix_tree, url_rules
from coinstrata.llm._common import Words, shingle_sets, text_rows
from coinstrata.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("the", "of", "Wandering", "leaf,", "größe", "niño", "tree.", "a", f"w{r.randrange(300)}")) for _ in range(n))


def sample():
    texts = ["", None, "   \n\t", "one", "Two words", "four words are here", prose(40, 1), prose(40, 1), prose(40, 1).upper(), "é ñ 中文 \u0085x y", "a\x1cb \x0b c", "x" * 3000, "12 34 !!", "a" * 5000 + " end"]
    base = prose(200, 2).split()
    for k in range(12):
        t = list(base)
        for j in range(k):
            t[(j * 37 + k) % len(t)] = f"edit{k}"
        texts.append(" ".join(t))
    texts += [prose(30 + 7 * k, 100 + k) + " shared passage of words that many texts hold for no good reason at all" for k in range(20)]
    texts += [prose(400, 9) + " tail"] * 5 + [prose(400, 9)]
    rows = [(3 * i + 1, t, ("en", "de", None)[i % 3], "s", None) for i, t in enumerate(texts)]
    return rows + [(None, prose(40, 1), None, None, 7), (None, None, None, None, None), rows[6], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return sample()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_words_and_shingles(plain):
    texts = [t for _, t, *_ in plain]
    raw = [(t or "").encode() for t in texts]
    w = Words(raw)
    assert w.doc_words.tolist() == [len(words(t)) for t in texts]
    h = w.hashes()
    flat = [x for t in texts for x in words(t)]
    assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(h.tolist(), flat))) == len(set(flat))
    sets = shingle_sets(raw)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(texts[i]) & shingles(texts[j]))


# --- op1


def plain_tree(texts, train):
    """Brute force: the root, the states and chance(history, symbol) of texts (lists of tokens, None the end)."""
    c = collections.Counter(w for x, on in zip(texts, train) if on for w in x)
    n, v = sum(c.values()), len(c)
    v1, v2 = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    less = v1 / (v1 + 2 * v2) if v1 and v2 else 0.5
    level = lambda k: k if k <= 16 else 17 + int(8 * math.log2(k / 16))
    alike = collections.defaultdict(list)
    for k in c.values():
        alike[level(k)].append(k)
    name = lambda w: w if c[w] else "unknown"
    after = collections.defaultdict(collections.Counter)
    for x, on in zip(texts, train):
        for i, w in enumerate(x) if on else ():
            history = tuple(map(name, ([None, None] + x)[i : i + 2]))
            after[history[1:]][w] += 1
            after[history][w] += 1

    states = set()

    def chance(history, w, depth=2):
        if depth == 0:
            same = alike[level(c[w])] if w in c else None
            return (sum(same) / len(same) - less) / n if same else less * v / n
        p, s = chance(history, w, depth - 1), history[2 - depth :]
        if s not in states:
            return p
        kinds, total = len(after[s]), sum(after[s].values())
        return (after[s][w] + kinds * p) / (total + kinds)

    for depth in (1, 2):
        for s in [s for s in after if len(s) == depth]:
            history, f = (None, *s)[-2:], after[s]
            lower = {w: chance(history, w, depth - 1) for w in f}
            kinds, total = len(f), sum(f.values())
            gain = sum(k * math.log((k + kinds * lower[w]) / (total + kinds) / lower[w]) + math.log(lower[w]) for w, k in f.items())
            if gain > kinds * math.log(max(total, 2)) / 2:
                states.add(s)
    return c, states, chance, name


def test_suffix_tree(docs, plain, none, spark, monkeypatch):
    got = suffix_tree.score_texts(docs).collect()
    tok = [(i, words(t) + [None]) for i, t, *_ in plain]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, states, chance, name = plain_tree([x for _, x in tok], [not held(i) for i, _ in tok])
    n, v = sum(c.values()), len(c)
    want = sorted(key((i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6))) for i, x in tok)
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
    assert {len(s) for s in states} == {1, 2}
    scores = {(r.doc_id, r.n_tokens): r.score for r in got}
    for i, x in tok:
        history = list(map(name, [None, None] + x))
        p = [chance(tuple(history[k : k + 2]), name(w)) for k, w in enumerate(x)]
        assert abs(sum(map(math.log10, p)) - scores[i, len(x)]) < 0.02
    # every state's chances and those of the root sum to 1 over the training tokens and the unknown one
    for s in [(), *sorted(states, key=str)[::29]]:
        assert abs(sum(chance((None, None, *s)[-2:], w) for w in [*c, "unknown"]) - 1) < 1e-9
    assert suffix_tree.score_texts(none).count() == 0
    # blocks of any size, and other numbers of owners, give the same
    small = suffix_tree.score_texts(docs.repartition(1).withColumn("held", F.lit(1)).withColumn("block", F.lit("x"))).collect()
    for x, y in zip(*(sorted((r.doc_id or 0, r.n_tokens, r.score) for r in rows) for rows in (small, got))):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 0.02


def test_suffix_tree_knows_the_order_of_words(spark):
    """Contexts matter: a text seen twice is likelier than its words in another order, however much else there is."""
    twice = " ".join(f"w{k}" for k in range(40))
    mixed = " ".join(f"w{(7 * k) % 40}" for k in range(40))
    for rest in (0, 200_000):
        ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
        out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
        rows = [(ids[0], twice), (ids[1], twice), (ids[2], "aaaa bbbb " * rest), (out[0], twice), (out[1], mixed), (None, "x " + twice)]
        got = {r.doc_id: r.score for r in suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[out[0]] == pytest.approx(got[ids[0]], abs=0.02) and got[out[0]] > got[out[1]] + 20


def test_suffix_tree_splits_hot_tokens(spark, monkeypatch):
    """A token over the limit lies with several owners, whose chances still sum to 1 for each context."""
    r = np.random.default_rng(2)
    n = 4000
    context, before = r.integers(0, 3, n).astype(np.uint32), r.integers(0, 5, n).astype(np.uint32)
    symbol, count = r.integers(0, 30, n).astype(np.uint32), r.integers(0, 4, n)
    root = (np.arange(1, 31) / np.arange(1, 31).sum())[symbol]
    p = suffix_tree.grow(context, before, symbol, count, root)
    seen = {}
    for k in zip(context.tolist(), before.tolist(), symbol.tolist(), p.tolist()):
        assert seen.setdefault(k[:3], k[3]) == k[3]
    sums = collections.Counter()
    for (a, b, _), q in seen.items():
        sums[a, b] += q
    assert len(seen) == 450 and all(abs(x - 1) < 1e-9 for x in sums.values())
    monkeypatch.setattr(suffix_tree, "OWNER_EVENTS", 50)
    h = np.append(np.unique(r.integers(0, 1 << 62, 40, dtype=np.uint64)), suffix_tree.END_HASH)
    seq = np.append(r.integers(0, 40, 999), 40)
    row = {"hashes": h.tobytes(), "seq": suffix_tree._packed(seq), "tokens": [1000]}
    cuts, context, *_ = suffix_tree._events(row, np.where(np.arange(41) == 7, 900, 10), 64)
    assert len(set(context.tolist())) > 41 + 10 and (np.diff(cuts) > 0).sum() > 20


def test_suffix_tree_scores_alike_beyond_the_limit(spark):
    """A token over the limit is one context: what follows it is as likely whatever rare word stands before."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    text = "".join(f"w{k} the {y} " * 150_000 for k, y in enumerate("abcdefgh"))
    rows = [(None, text), *((i, f"u{i} the a") for i in ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.score for r in suffix_tree.score_texts(docs).filter("held_out").collect()}
    # "the" and "a" are states (w0 and once w1 follow "a"), an unknown token and an end that stands before one word are none
    n, v = 3_600_001, 18
    same = (150_000 - 0.5) / n  # tokens of one class of counts; only the end is seen once
    seen = lambda c, kinds, total, lower: (c + kinds * lower) / (total + kinds)
    root = {"the": (1_200_000 - 0.5) / n, "a": same, "end": 0.5 / n, "unknown": 0.5 * v / n}
    want = [root["unknown"], root["the"], seen(150_000, 8, 1_200_000, root["a"]), seen(0, 2, 150_000, root["end"])]
    assert len(scores) == 1 and scores.pop() == pytest.approx(sum(map(math.log10, want)), abs=0.001)


@pytest.mark.parametrize("limit", [1, 12, 60])
def test_suffix_tree_is_the_same_by_any_limit(docs, spark, limit):
    """Neither the limit, which makes tokens, pairs and ends hot, nor blocks nor owners change a score."""
    rows = lambda df, **kw: sorted(key(r) for r in suffix_tree.score_texts(df, **kw).collect())
    want = rows(docs)
    assert rows(docs, owner_events=limit) == want
    assert rows(docs.repartition(1), owner_events=limit) == want


def test_suffix_tree_on_held_out_texts(spark):
    """Texts that the tree hasn't seen are likelier by it than by unigrams."""
    sums = suffix_tree.score_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).groupBy("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).collect()
    assert len(sums) == 2 and all(r.score > r.base for r in sums)


# --- op2


def test_rice_codes():
    r = np.random.default_rng(1)
    for bits, n in ((64, 1), (64, 500), (40, 3000), (12, 900), (8, 256), (1, 2)):
        x = np.unique(r.integers(0, 1 << min(bits, 62), n, dtype=np.uint64))
        b, data = exact_dedup.rice_encode(x)
        assert np.array_equal(exact_dedup.rice_decode(len(x), b, data), x)


def test_exact_dedup(docs, plain, none, spark):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in plain:
        groups[t or ""].append(i)
    top = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    want = sorted(key((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t, *_ in plain)
    assert sorted(key((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1} and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0
    left = exact_dedup.keep_one(docs.withColumn("kept", F.lit(1)).withColumn("fp", F.lit("x")))
    assert left.columns[-2:] == ["kept", "fp"] and left.count() == len(groups)


def test_rows_go_by_id_and_text(spark):
    rows = [(None, "a"), (None, "a"), (None, "unique"), (None, None), (None, ""), (5, "b"), (9, "b"), (5, "only here"), (7, "c"), (7, "c"), (7, "d"), (None, "c")]
    left = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "a"), (0, "unique"), (5, "only here"), (7, "c"), (7, "d"), (9, "b")]


def test_near_rows_go_by_text(spark):
    import corpus_pipeline

    one, two, three = (prose(60, k) + f" own{k}" for k in (31, 32, 33))
    rows = [(None, one), (None, one + " end"), (None, "alone"), (None, None), (4, two), (4, "another"), (3, two + " end"), (3, "third"), (None, three), (8, three + " end")]
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    kept = collections.Counter((r.doc_id, r.text) for r in left)
    assert kept.pop((None, one), 0) + kept.pop((None, one + " end"), 0) == 1
    assert kept == collections.Counter([(None, "alone"), (None, None), (4, "another"), (3, two + " end"), (3, "third"), (8, three + " end")])


def test_a_hot_shingle(spark):
    """A passage that all texts share, in groups of near copies of many sizes and one very long text."""
    r = random.Random(11)
    passage = "a passage of words that every one of these texts holds " * 2
    rows = []
    for g in range(40):
        own = [f"g{g}w{r.randrange(500)}" for _ in range(60 + 5 * g)]
        for k in range(r.randrange(1, 6)):
            t = list(own)
            t[k] = f"edit{k}"
            rows.append((len(rows) + 1, passage + " ".join(t)))
    rows += [(len(rows) + 1, passage + " ".join(f"l{r.randrange(10**6)}" for _ in range(60_000)))]
    rows += [(len(rows) + 1, rows[-1][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("h", F.lit(2)).repartition(5)
    got = {x.doc_id: x.component_id for x in jaccard_join.near_groups(docs).collect()}
    assert [got[i] for i, _ in rows] == brute_components([i for i, _ in rows], [shingles(t) for _, t in rows])


def test_a_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(rows)
    assert got.filter("group_size = 1000 AND keep_id = 2997").count() == 1000 and got.filter("kept").count() == 2001


# --- op3


def test_scaled_sketch(docs, plain, none):
    got = scaled_sketch.compare_edited(docs).collect()
    rows = sorted(((i, t or "") for i, t, *_ in plain), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want, likes = [], {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
        likes[want[-1]] = (t, e, after)
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    for r in got:
        t, e, after = likes[(r.doc_id, r.n_chars, r.edited_sha256)]
        a, b = scaled_sketch.of_text(r.fingerprint), scaled_sketch.of_text(r.edited_fingerprint)
        assert scaled_sketch.text_of(a) == r.fingerprint and (len(a) > 0) == bool(words(t))
        assert r.near_edited == scaled_sketch.likeness(a, b) and 0 <= r.near_next <= 1
        if t == after:
            assert r.near_next == 1
    assert len({r.fingerprint for r in got if r.n_chars == len(prose(40, 1)) and r.doc_id in (19, 22, None)}) == 1
    assert scaled_sketch.compare_edited(none).count() == 0


def test_sketches_hold_every_small_hash(docs, plain):
    """Fingerprints and likenesses against sets of single shingles, hashed one by one."""
    def plain_sketch(text):
        hashes = {int(shingle_sets([" ".join(x).encode()])[0][0]) for x in shingles(text)}
        kept = {h for h in hashes if h < (1 << 64) // scaled_sketch.SCALE} or ({min(hashes)} if hashes else set())
        return {h >> (64 - scaled_sketch.BITS) for h in kept}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    rows = sorted({(i, t or "") for i, t, *_ in plain if i is not None}, key=lambda r: (-r[0], r[1]))
    got = {(r.doc_id, r.n_chars): r for r in scaled_sketch.compare_edited(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("fingerprint", F.lit("x")).withColumn("next", F.lit(1))).collect()}
    memo = {t: plain_sketch(t) for _, t in rows}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = plain_sketch(t[: len(t) - half] + after[:half])
        r = got[i, len(t)]
        assert set(scaled_sketch.of_text(r.fingerprint).tolist()) == memo[t] and set(scaled_sketch.of_text(r.edited_fingerprint).tolist()) == edited
        assert r.near_edited == pytest.approx(like(memo[t], edited)) and r.near_next == pytest.approx(like(memo[t], memo[after]))


def test_sketches_estimate_and_merge():
    texts = [prose(3000, 5), prose(3000, 5) + " " + prose(3000, 6), prose(200, 7)]
    a, b, c = scaled_sketch.sketches([t.encode() for t in texts])
    assert abs(scaled_sketch.containment(a, b) - 1) < 0.02 and scaled_sketch.containment(c, b) < 0.05
    x, y = shingles(texts[0]), shingles(texts[1])
    assert abs(scaled_sketch.likeness(a, b) - len(x & y) / len(x | y)) < 0.06
    both = [np.union1d(*shingle_sets([texts[0].encode(), texts[2].encode()]))]
    assert np.array_equal(scaled_sketch.merge(a, c), scaled_sketch.sketch(both[0]))


# --- op4


def brute_components(rows, sets):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for k, i in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [i if not sets[k] else low.get(find(k), i) for k, i in enumerate(rows)]


def test_jaccard_join(docs, plain, none):
    got = jaccard_join.near_groups(docs.withColumn("n", F.lit(1)).withColumn("node", F.lit(2))).collect()
    sets = [shingles(t) for _, t, *_ in plain]
    want = sorted(key(x) for x in zip([i for i, *_ in plain], [len(s) for s in sets], brute_components([i for i, *_ in plain], sets)))
    assert sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert jaccard_join.near_groups(none).count() == 0


def test_jaccard_join_at_the_threshold(spark):
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(60 + 9 * g)]
        for k in range(14):
            t = list(base)
            for _ in range(r.randrange(5)):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(t[: len(t) - r.randrange(8)])))
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_components([i for i, _ in rows], [shingles(t) for _, t in rows])
    assert [got[i] for i, _ in rows] == want and 12 < len(set(want)) < len(rows)


def plain_links(rows):
    """(doc_id, n_shingles, class_id, n_links) by comparing all pairs."""
    sets = [frozenset(shingles(t)) for _, t, *_ in rows]
    out = []
    for (i, *_), s in zip(rows, sets):
        same = [r[0] for r, x in zip(rows, sets) if s and x == s and r[0] is not None]
        near = sum(bool(s) and 100 * len(s & x) >= 80 * len(s | x) for x in sets)
        out.append(key((i, len(s), min(same, default=i), max(0, near - 1))))
    return sorted(out)


def test_every_link(docs, plain, none, spark, monkeypatch):
    got = jaccard_join.near_links(docs.withColumn("k", F.lit(1)).withColumn("low", F.lit(2))).collect()
    assert sorted(key(tuple(r)) for r in got) == plain_links(plain)
    assert jaccard_join.near_links(none).count() == 0
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # a group of near copies over many tiles
    r = random.Random(8)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(90):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        rows += [(len(rows) + j, " ".join(t[: len(t) - r.randrange(9)])) for j in range(1, 2 + (k % 4 == 0))]
    got = jaccard_join.near_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = plain_links(rows)
    assert sorted(key(tuple(x)) for x in got) == want and len({x[3] for x in want}) > 10


def test_signatures_never_lose():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 900))
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 62, max(1, n // 10), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        x, y = jaccard_join.signature(a), jaccard_join.signature(b)
        w = min(len(x), len(y))
        x, y = jaccard_join.fold(x, w), jaccard_join.fold(y, w)
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert both <= bound
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert jaccard_join.may_link(len(a), len(b), len(a) - bound, 0)


def test_tiles_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = [(1, i * 7919 - 20, i, n, 0, 20) for i, n in enumerate([10, 11, 12, 12, 13, 14, 15, 16, 18, 20, 22, 25, 25, 26, 30, 33, 36, 40, 41, 50])]
    t = jaccard_join._tiles(spark.createDataFrame(rows, "h long, node long, root long, n long, own long, k long")).collect()
    size = {node: n for _, node, _, n, _, _ in rows}
    met = collections.Counter()
    groups = collections.defaultdict(list)
    for x in t:
        groups[(x.h, x.lo, x.up, x.i, x.j)].append(x)
    for g in groups.values():
        for a in g:
            for b in g:
                if a.side < 2 and b.side != 1 and (a.side > 0 or a.node < b.node):
                    met[tuple(sorted((a.node, b.node)))] += 1
    close = {tuple(sorted((a, b))) for a in size for b in size if a != b and min(size[a], size[b]) * 100 >= 80 * max(size[a], size[b])}
    assert close <= set(met) and max(met.values()) == 1


def test_components(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(5, 5), (7, None)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    rows = sorted({x for l in links for x in l if x is not None})
    low = {x: x for x in rows}
    for _ in rows:
        for a, b in links:
            if b is not None:
                low[a] = low[b] = min(low[a], low[b])
    assert all(got.get(x, x) == low[x] for x in rows)


# --- op5


def urls(spark):
    rows = [
        ("https://a.example.org/es/1", "allow"), ("http://EXAMPLE.org/es/1", "block"), ("http://x.example.org/en/12", "block"), ("http://x.example.org/en/2", "allow"), ("http://b.com/fr/x?y", "allow"),
        ("http://b.com/de/", "block"), ("http://b.com/en/", "allow"), ("no url", "allow"), (None, "allow"), ("http://org/", "allow"), ("http://notexample.org", "allow"), ("x://h?//q/de/#f", "allow"),
    ]
    rows += [(f"http://free-bets.site.net/en/{k}", "block") for k in range(9)] + [(f"http://plain.site.net/en/{k}", "allow") for k in range(30)] + [(f"http://free.site.net/en/{k}", "allow") for k in range(9)]
    return spark.createDataFrame([(i, u, "html") for i, (u, _) in enumerate(rows)], "page_id long, url string, html string"), [v for _, v in rows]


def test_url_rules(spark):
    pages, _ = urls(spark)
    got = {r.page_id: r for r in url_rules.filter_urls(pages).collect()}
    rows = {r.page_id: r.url for r in pages.collect()}
    for i, url in rows.items():
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = host.translate(UPPER)
        fits = [(len(r), r, v) for v, r in url_rules.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1])
        assert got[i].verdict == (best[2] or ("block" if "bets" in host else "allow")), url
    assert {r.mined for r in got.values() if "bets" in r.host} == {"h:bets"}
    assert url_rules.filter_urls(pages.filter("page_id < 0")).count() == 0


def test_url_rules_from_labels(spark):
    pages, _ = urls(spark)
    labels = pages.select("page_id", F.when(F.col("url").contains("free") & F.col("url").contains("bets"), "block").otherwise("allow").alias("label"))
    got = url_rules.filter_urls(pages, labels, rules=(("allow", "org/"),))
    assert got.filter("verdict = 'block'").count() == 9 and got.filter("mined IS NOT NULL AND confidence < 0.9").count() == 0


def test_url_rules_of_many_tokens(spark):
    """Only all four tokens together tell the blocked urls; each three of them stand in as many allowed ones."""
    parts = [("shop", "plain"), ("net", "info"), ("en", "fr"), ("deal", "news")]
    rows = [(None, "block")] * 20 + [(k, "allow") for k in range(4) for _ in range(20)]
    pages, labels = [], []
    for i, (missing, label) in enumerate(rows):
        a, b, c, d = (p[k == missing] for k, p in enumerate(parts))
        pages.append((i, f"http://{a}.{b}/{c}/{d}/{i}"))
        labels.append((i, label))
    got = url_rules.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, label string"), rules=(("allow", "org/"),))
    assert {r.page_id: r.verdict for r in got.collect()} == dict(labels)
    assert got.filter("mined = 'h:net+h:shop+p:deal+p:en'").count() == 20


def plain_rules(rows, least, confidence):
    """Brute force: minimal sets of tokens, those of equal cover as one, with their counts."""
    count = lambda s, bad: sum(s <= set(t) and (not bad or lab == "block") for t, lab in rows)
    tokens = sorted({x for t, _ in rows for x in t})
    often = [x for x in tokens if count({x}, True) >= least]
    rules = {frozenset([x]) for x in often if count({x}, True) >= confidence * count({x}, False)}
    groups = collections.defaultdict(list)
    for x in often:
        if frozenset([x]) not in rules:
            groups[tuple(i for i, (t, lab) in enumerate(rows) if lab == "block" and x in t)].append(x)
    found = set(rules)
    for size in range(1, len(groups) + 1):
        for some in itertools.combinations(groups.values(), size):
            s = frozenset(itertools.chain(*some))
            if count(s, True) >= least and count(s, True) >= confidence * count(s, False):
                found.add(s)
    return {"+".join(sorted(s)): (count(s, True) / count(s, False), count(s, True) / len(rows)) for s in found if not any(o < s for o in found)}


def test_mined_rules(spark):
    r = random.Random(12)
    sizes = set()
    for k in range(4):
        rows = []
        for _ in range(90):
            t = sorted({r.choice("abcdefgh"[: 5 + k]) for _ in range(r.randrange(1, 6))})
            bad = ("a" in t and "b" in t) or ("c" in t and "d" in t and "e" in t and k > 1) or r.random() < 0.1
            rows.append((t + (["u", "v", "w"] if bad and "c" in t else []), "block" if bad else "allow"))
        rows += [(["u", "v"], "allow"), (["v", "w"], "allow"), ([], "block"), (["z"], "other")]
        got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.0, 0.8, 3).collect()
        want = plain_rules(rows, 3, 0.8)
        assert {x.rule: (pytest.approx(x.confidence), pytest.approx(x.support)) for x in got} == want
        sizes |= {len(x.items) for x in got}
    assert {2, 3} <= sizes


def test_a_hot_url(spark):
    """A long url that is repeated is no harder than a short one, whether its words are telling alone or not."""
    long = "/".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    words = long.split("/")
    pages = [(k, f"http://bets.shop.net/{long}/{k % 2}") for k in range(1000)] + [(2000 + k, f"http://a.net/{w}/x") for k, w in enumerate(words * 200)] + [(None, None), (1500, "http://b.net/" + "x" * 200_000)]
    began = time.monotonic()
    docs = spark.createDataFrame(pages, "page_id long, url string").withColumn("anchor", F.lit(1)).withColumn("items", F.lit(2))
    got = url_rules.filter_urls(docs, rules=(("allow", "org/"),))
    assert {r.verdict: r["count"] for r in got.groupBy("verdict").count().collect()} == {"block": 1000, "allow": 8002}
    labels = docs.filter("page_id IS NOT NULL").select("page_id", F.when(F.col("page_id") < 1000, "block").otherwise("allow").alias("label"))
    plain = docs.withColumn("url", F.regexp_replace("url", "bets.shop", "a"))
    got = url_rules.filter_urls(plain, labels, rules=(("allow", "org/"),))
    assert got.filter("verdict = 'block'").count() == 1000 and got.filter("mined IS NOT NULL").select("mined").distinct().count() >= 1
    assert time.monotonic() - began < 100


# --- op6 and op8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(docs, plain, none, library):
    got = sorted(key(r) for r in bpe.encode_digests(docs).collect())
    want = []
    for i, t, *_ in plain:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append(key((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert got == sorted(want) and bpe.encode_digests(none).count() == 0


def test_bpe_on_random_text(library):
    r = random.Random(5)
    coder = bpe.WordBpe(bpe.default_path(), True)
    for k in range(400):
        signs = r.choice(("ab", "thein", "aeioulnrst", "abcdefghijklmnopqrstuvwxyzéñß", "0123456789", "!?.-=+*'", "aéαбщ中 \u0301"))
        t = "".join(r.choice(signs) for _ in range(r.choice((1, 6, 30, 120, 700))))
        t += r.choice(("", " ", " \x1c", "\x85", "\u00a0", "\u2003ß ", "'s ", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|x", " \u0301", "\x00")) + t.upper()
        ((got, text),) = coder.encoded([t.encode()])
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids and text.decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_long_unsplit_text(library):
    """Runs in which no two halves agree, and scripts without spaces, are done in seconds and as the library does."""
    r = random.Random(6)
    cyrillic, greek, han = ("".join(chr(r.randrange(a, z)) for _ in range(n)) for a, z, n in ((0x430, 0x450, 500_000), (0x3B1, 0x3CA, 30_000), (0x4E00, 0x9FA0, 100_000)))
    texts = ["ba" + "a" * 100_000, "a" * 1_000_000, "ab" * 20_000 + "c", "!" * 50_001, cyrillic, greek.upper(), han, "e\u0301" * 9_000, "x" * 5_000 + "<|endoftext|>" + "y" * 4_999, "thein" * 3_000 + "<|x"]
    coder = bpe.WordBpe(bpe.default_path(), True)
    for t in texts:
        began = time.monotonic()
        ((got, text),) = coder.encoded([t.encode()])
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, t[:20]
        assert text.decode() == library.decode(ids, skip_special_tokens=False)
        assert time.monotonic() - began < 60


def test_bpe_joins_at_every_place(library):
    """Any two stretches of a piece join to the encoding of the whole."""
    r = random.Random(9)
    coder = bpe.WordBpe(bpe.default_path())
    for signs in ("a", "ab", "thein", "aeioulnrst", "aeéñ"):
        for _ in range(60):
            t = "".join(r.choice(signs) for _ in range(r.randrange(2, 90))).encode().decode("latin-1").translate(coder.to_signs)
            at = r.randrange(1, len(t))
            left, right = coder._encode_signs([t[:at], t[at:]], True)
            assert coder.join(left, right) == [x.id for x in library.model.tokenize(t)]


def check_pieces(rows, ids_of, tiers=packing.TIERS):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    short = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        total = sum(p.length for p in pieces)
        short += total not in tiers
        assert total <= tiers[0] and {p.tier for p in pieces} == {total if total in tiers else tiers[0]}
    for i, ids in ids_of.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))] and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
    return short


def test_packing(docs, plain, none, library):
    once = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(once).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in plain if i is not None}
    assert check_pieces(rows, ids) <= 4
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_documents(docs).filter("doc_id IS NULL").agg(F.sum("length")).first()[0] == len(library.encode(prose(40, 1), add_special_tokens=False).ids) + 2


def test_packer_blocks():
    r = random.Random(2)
    p, rows, want = packing.Packer((16, 8, 4, 2), 0, 64), [], {}
    for i in range(300):
        ids = [r.randrange(9) for _ in range(r.choice((1, 2, 3, 5, 7, 9, 15, 16, 17, 40)))]
        want[i] = ids
        p.add(i, np.array(ids, "<u4").tobytes())
        if i % 37 == 0:
            rows += p.flush()
    rows += p.flush(True)
    assert check_pieces([collections.namedtuple("R", packing._OUT.names)(*x) for x in rows], want, (16, 8, 4, 2)) <= 1
    assert {x[7] for x in rows} == {16, 8, 4, 2} and not p.docs


def test_steps_are_balanced():
    r = random.Random(3)
    s, out, given = packing.Steps(0, 64, 4), [], []
    for k in range(500):
        given.append(r.choice((16, 8, 4, 2)))
        s.add(given[-1], [(k, given[-1])])
        if k % 50 == 0:
            out += s.deal()
    out += s.deal(True)
    assert sorted(x[:2] for x in out) == sorted(enumerate(given))
    groups = collections.defaultdict(collections.Counter)
    for _, tier, g in out:
        groups[g][tier] += 1
    tokens = [sum(t * n for t, n in groups[g].items()) for g in sorted(groups)]
    whole = len(tokens) // 4 * 4 - 4
    assert set(tokens[:whole]) == {64} and 64 <= min(tokens) and max(tokens) - min(tokens[whole:]) <= 32
    for a in range(0, whole, 4):
        for tier in (16, 8):
            n = [groups[g][tier] for g in sorted(groups)[a : a + 4]]
            assert max(n) - min(n) <= 1 + (tier == 8)


# --- op7


def languages(spark, n=240):
    r = random.Random(3)
    parts = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ung ich die ver ge au zu be".split(), "fr": "eau oi ment que eux é è tion ou ai".split()}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(5, 60))), lang, "s", 0))
    return spark.createDataFrame(rows + [(n, None, "en", "s", 0), (n + 1, "12 !! 34", "de", "s", 0), (n + 2, "", None, None, None), (None, "sch ung", "de", None, 1), (n + 3, "中文", None, None, None)], SCHEMA)


def test_language_id(spark, none):
    docs = languages(spark)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert g.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1
        if r.doc_id is not None and r.doc_id < 240:
            assert g.accepted and g.lang_pred in ("de", "en", "fr")
    held = [r for r in docs.collect() if r.doc_id is not None and r.doc_id < 240 and got[r.doc_id].held_out]
    assert len(held) > 40 and sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and got[243].lang_pred != "und" and not got[241].accepted
    swapped = docs.withColumn("lang", F.when(language_id.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(swapped).collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}
    assert language_id.identify(none).count() == 0
    assert language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.keep_accepted(docs).count() == sum(r.accepted for r in got.values())


def test_features_stay_in_words():
    a, at = language_id.features([b"ab cd", b"", b"ab  cd"])
    assert at.tolist()[1] == at.tolist()[2] and sorted(a[: at[1]]) == sorted(a[at[2] :])


def test_predictions_by_a_plain_loop(spark, monkeypatch):
    texts, langs = language_id.sample(languages(spark))
    model = language_id.train(texts, langs)
    step, mask = [int(x) for x in language_id._STEP], (1 << 64) - 1
    bits = 64 - language_id.BUCKETS.bit_length() + 1

    def slow(text):
        raw = b" " + text + b"    "
        space = [b in b" \t\n\v\f\r" for b in raw]
        low = [32 if s else b + 32 if 65 <= b <= 90 else b for b, s in zip(raw, space)]
        rows = []
        for i in range(len(raw) - 4):
            h = 0
            for k in range(1, 5):
                h = (h + int(language_id._TABLE[low[i + k - 1]])) * step[k - 1] & mask
                if not (space[i] and space[i + k - 1]) and not any(space[i + 1 : i + k - 1]):
                    rows.append(model.table[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> bits].astype(float))
        z = [(sum(r[k] for r in rows) / max(1, len(rows)) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
        e = [math.exp(x - max(z)) for x in z]
        return model.langs[max(range(len(e)), key=e.__getitem__)], max(e) / sum(e)

    some = [*texts[:25], "größe  Niño\n\tx".encode(), b"a", b"A b C d"]
    for size in (language_id.SLICE, 40):
        monkeypatch.setattr(language_id, "SLICE", size)
        monkeypatch.setattr(language_id.parts, "__defaults__", (size,))
        for t, (lang, score, _) in zip(some, language_id.predict(model, some)):
            want = slow(t)
            assert lang == want[0] and score == pytest.approx(want[1], abs=1e-6)


def test_language_of_a_long_text(spark):
    """Ten megabytes are a matter of slices, and an id that repeats doesn't swell the sample."""
    docs = languages(spark).withColumn("table", F.lit("x")).withColumn("place", F.lit(1))
    model = language_id.train(*language_id.sample(docs))
    text = " ".join(r.text for r in docs.filter("lang = 'en' AND text IS NOT NULL").collect()).encode()
    long = text * (10_000_000 // len(text)) + b"x" * 600_000
    tracemalloc.start()
    ((lang, score, ok),) = language_id.predict(model, [long])
    assert (lang, ok) == ("en", True) and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    many = docs.union(docs.filter("doc_id = 3").select(*docs.columns).crossJoin(spark.range(3000)).drop("id"))
    assert len(language_id.sample(many, most=100)[0]) <= 300


# --- op9


def test_license_scan(spark, none):
    texts = [
        "Licensed under the Apache License, Version 2.0. Apache license", "released under the MIT license. Released under the MIT license!", "cc by; CC-BY-NC", "Licensed under CC BY-NC 4.0", "gnu general public", "GNU General Public License v3",
        "this work is licensed under the gnu general and public license version 3", "", None, "license mit", "mit\u00e9 license mit license",
    ]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts + [texts[0]])] + [(0, texts[0], "y", 6), (None, texts[2], None, None)], "doc_id long, text string, word string, place int")
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        t = {**dict(enumerate(texts + [texts[0]])), None: texts[2]}[r.doc_id]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        base = [(i, lab) for p, lab in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(base))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r.labels for r in got}
    assert by[0] == "apache,apache-2.0" and by[1] == "mit,mit-notice" and by[3] == "cc-by,cc-by-nc-4.0" and by[6] == "gpl-3.0" and by[9] == ""
    assert license_scan.scan_licenses(none).count() == 0


def plain_labels(w, templates):
    """Brute force: templates of which some band of diagonals covers enough words by runs in order."""
    out = set()
    for text, label in templates.items():
        t = text.split()
        k = min(license_scan.K, len(t))
        hits = [(p, q) for p in range(len(w) - k + 1) for q in range(len(t) - k + 1) if w[p : p + k] == t[q : q + k]]
        for d in {p - q for p, q in hits}:
            first = {}
            for p, q in hits:
                if d <= p - q <= d + license_scan.SHIFT:
                    first[q] = min(p, first.get(q, p))
            covered, top = set(), -1
            for q, p in sorted(first.items()):
                if p > top:
                    covered |= set(range(q, q + k))
                top = max(top, p)
            if len(covered) >= license_scan.COVER * len(t):
                out.add(label)
    return out


def test_license_spans(spark):
    """Whole texts, with words changed, left out and put in, repeated and among others; more text never takes a label away."""
    r = random.Random(7)
    bodies = list(license_scan.TEMPLATES)
    texts = ["released under the mit license", "released under the mit license" + " mit license" * 5, "mit license " * 50 + "released under the mit license " * 3]
    for body in bodies:
        w = body.split()
        for edits in (0, 1, 3, 8):
            x = list(w)
            for _ in range(edits):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice(([], [x[i], "extra"], ["other"]))
            texts.append(" ".join(["some", "words"] + x + r.choice((["end"], x, w[:5], w[::-1]))))
    texts.append(" ".join(texts) + " long " * 30_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("off", F.lit(2)).repartition(3)
    got = {x.doc_id: set(x.labels.split(",")) - {""} for x in license_scan.scan_licenses(docs).collect()}
    assert "mit-notice" in got[0] and "mit-notice" in got[1] and "mit-notice" in got[2]
    for i, t in enumerate(texts[:-1]):
        w = t.split()
        base = {lab for p, lab in license_scan.PHRASES.items() if f" {p} " in f" {t} "}
        assert got[i] == plain_labels(w, license_scan.TEMPLATES) | base, t
    assert set().union(*(got[i] for i in range(len(texts) - 1))) <= got[len(texts) - 1]
    assert {"mit-full", "bsd-2-clause", "gpl-3.0-or-later", "zlib"} <= got[len(texts) - 1]


# --- op10


def test_secrets(spark, none):
    r = random.Random(8)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["", None, 'é token = "abc123def" x', "password: token: abcdefgh", "API_KEY='x' secret=shorty", "AKIA" + "Z9" * 9, "AKIAAKIA1", "deadbeef" * 4 + " 0123", "ſecret=abcdefgh", "a" * 100 + "ü passwd==zzzzzzz"]
    texts += [f"ü{prose(20, k)} {''.join(r.choice(b62) for _ in range(40))} end" for k in range(30)] + ["internationalizationsandlocalizations rererererererererererererere " + prose(9, k) for k in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    patterns = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for i, t in enumerate(texts):
        spans = []
        for k, (kind, least) in enumerate((("assign", 6), ("access", 20), ("hex", 24))):
            spans += [(m.start(), k, m.end(), kind) for m in patterns[kind].finditer(t or "") if len(m[2] if kind == "assign" else m[0]) >= least]
        spans.sort()
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[3] == k for x in spans) for k in ("assign", "access", "hex")]
        for x in filter(None, got[i].spans.split(",")):
            kind, s, e = x.split(":")
            if kind == "random":
                assert len(t[int(s) : int(e)]) == 40 and t[int(s) : int(e)].isalnum()
    assert sum(got[i].n_random for i in range(10, 40)) >= 25 and sum(got[i].n_random for i in range(40, 70)) == 0
    assert secrets.find_secrets(none).count() == 0
    kept = {r.doc_id: r for r in secrets.redact(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert len(kept) == len(texts) and kept[2].text == "é [REDACTED] x" or kept[2].text == 'é [REDACTED]" x'
    assert kept[1].text is None and all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)


def test_copies_of_a_token_count_once(spark):
    r = random.Random(5)
    tokens = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(400)]
    hot = min(tokens, key=lambda t: abs(secrets.randomness(t) - 0.3))
    rows = [f"a {t} b" for t in tokens]
    docs, copies = (spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string").repartition(3) for x in (rows, rows + [f"a {hot} b"] * 4000))
    least = secrets.thresholds(docs)
    assert least[secrets.band_of(40)] < 0.2 and secrets.thresholds(copies) == least
    assert secrets.find_secrets(copies).filter("doc_id >= 400 AND n_random = 1").count() == 4000


def test_p_values_are_uniform():
    """Random tokens of every alphabet and of lengths between the simulated ones."""
    r = random.Random(2)
    for _, alphabet in secrets._ALPHABETS:
        for n in (20, 30, 45, 100):
            tokens = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(150)]
            p = sorted(secrets.randomness(t) for t in tokens if secrets.encoding_of(t)[1] == alphabet)
            assert max(abs(x - (k + 0.5) / len(p)) for k, x in enumerate(p)) < 1.9 / math.sqrt(len(p)), (alphabet, n)


def test_random_spans_by_a_plain_loop(spark):
    """Candidates are the long runs that touch no base span, whatever their number; a long text is no square of work."""
    r = random.Random(4)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = []
    for _ in range(20_000):
        t = "".join(r.choice(b62) for _ in range(r.randrange(15, 40)))
        parts.append(r.choice((t, f"token={t}", "AKIA" + "Z" * 20, "deadbeef" * 4, f"secret: x/{t}+y", "word")))
    text = " ".join(parts).encode()
    began = time.monotonic()
    ((base, found),) = secrets.scan([text])
    assert time.monotonic() - began < 30
    short = text[:20_000].rsplit(b" ", 1)[0]
    ((base, found),) = secrets.scan([short])
    runs = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z+/_-]+", short) if m.end() - m.start() >= 20]
    want = [(s, e) for s, e in runs if not any(s < y and x < e for x, _, y in base)]
    assert [(s, e) for s, e, *_ in found] == want and len(want) > 50
    least = [0.1] * len(secrets.BANDS)
    ((spans, _),) = secrets.spans_of([short], least)
    assert [(s, e) for s, k, e in spans if k == 3] == [(s, e) for s, e in want if secrets.randomness(short[s:e].decode()) >= 0.1]


def test_randomness():
    r = random.Random(1)
    p = [secrets.randomness("".join(r.choice("0123456789abcdef") for _ in range(40))) for _ in range(300)]
    assert sum(x < 0.05 for x in p) < 45 and sum(x > 0.5 for x in p) > 90
    assert secrets.randomness("internationalization") < 0.01 and secrets.randomness("a" * 30) < 1e-9


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [tuple(r) for r in languages(spark).collect() if r.doc_id is not None]
    long = [r for r in rows if r[0] < 240 and len(r[1].split()) > 30][:2]
    rows += [(1000, rows[0][1], "en", "s", 0), (1001, long[0][1] + " end", "en", "s", 0), (1002, long[1][1] + ' token = "0123456789abcdef0123456789abcdef"', "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, secret = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, str(tmp_path))
        new.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    ids = {r.doc_id for r in kept.collect()}
    sets = {i: shingles(t) for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    assert not ids & {0, 240, 241, 242} and ids <= set(sets)
    for i in ids:
        for j in ids:
            assert i == j or 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])
    secret = kept.filter("text LIKE '%REDACTED%'").collect()
    assert len(secret) <= 1 and kept.filter("text LIKE '%0123456789abcdef%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_hashing_keeps_no_table_of_a_chunk_and_units_stay_near_their_text():
    from coinstrata.llm._common import _BASE, _BYTES, hashes_of, mix

    signs = np.frombuffer(prose(20_000, 5).encode()[: 1 << 16] + b"\n", dtype=np.uint8)
    starts = np.array([0, 3, 4090, 4095, 4096, 8192, len(signs) - 9, len(signs) - 1])
    ends = np.array([3, 3, 4100, 4096, 8193, 8192, len(signs), len(signs)])
    plain = [sum(int(_BYTES[signs[a + i]]) * pow(_BASE, i, 1 << 64) for i in range(z - a)) + z - a for a, z in zip(starts.tolist(), ends.tolist())]
    assert hashes_of(signs, starts, ends).tolist() == mix(np.array([x % (1 << 64) for x in plain], dtype=np.uint64)).tolist()
    text = prose(200_000, 6)[: 1_000_000].encode()
    tracemalloc.start()
    try:
        units = bpe.WordBpe.units([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(units[1]) > 100_000 and peak < 40 * len(text)
