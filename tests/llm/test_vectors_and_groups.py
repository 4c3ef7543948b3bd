"""Lattice hashing, order MinHash, seed and extend, against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, lattice, orderminhash, seedextend


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    want = roots(131, pairs)
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {x: want[x] for a, b in pairs if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest(x)
    near = ((x[:, None] - (p[:, None] + lattice.ROOTS[None])) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-9).all()  # no neighbour is nearer
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)
    assert np.allclose(p.sum(1) % 2, 0) and (np.allclose(p * 2 % 2 % 1, 0))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_against_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    crowd = rng.normal(size=(1, 32)) + 0.12 * rng.normal(size=(400, 32))  # one dense group, more than a block
    x = np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 32)), crowd, np.repeat(base[:1], 30, 0)]).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got = {r[0]: tuple(r)[1:] for r in lattice.linked(vectors(spark, rows, kind)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(len(x), zip(*np.nonzero(near), strict=True))
    found = sum(v[0] for v in got.values())
    assert all(v[0] <= near[k].sum() for k, v in got.items()) and found >= 0.99 * near.sum()
    assert sum(got[i][1] != w for i, w in enumerate(want)) <= 2
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for cos, low, high in ((0.902, 0.98, 1), (0.898, 0, 0)):
        x = np.concatenate([a, cos * a + np.sqrt(1 - cos * cos) * n])
        linked = lattice.linked(vectors(spark, enumerate(x.tolist()), "double")).where("vec_id < 600 and n_links > 0").count() / 600
        assert low <= linked <= high


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, None), (1, [0.0] * 3), (2, [float("nan")] * 3), (3, [1.0, None, 2.0]), (4, []), (5, v), (5, v), (None, v), (6, [1.0, 2.0]), (7, [float("inf")] * 3), (8, [2.0, 4.0, 6.0]), (9, [1e30, 2e30, 3e30])]
    got = sorted((tuple(r) for r in lattice.linked(vectors(spark, rows)).collect()), key=repr)
    assert [r for r in got if r[0] in (0, 1, 2, 3, 4, 6, 7)] == [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 6, 7)]
    assert [r for r in got if r[0] in (5, 8, 9, None)] == [(5, 4, 5, True), (5, 4, 5, True), (8, 4, 5, False), (9, 4, 5, False), (None, 4, 5, True)]
    assert lattice.linked(vectors(spark, [])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_is_exact():
    r = random.Random(3)
    pairs = []
    for _ in range(150):
        a = [r.randint(1, 30) for _ in range(r.randint(1, 120))]
        b = list(a)
        for _ in range(r.randint(0, int(len(a) * 0.4))):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.4 and b:
                b.pop(min(i, len(b) - 1))
            else:
                b.insert(i, r.randint(1, 30))
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    got = orderminhash.similarities(pairs, 0.8)
    quick = orderminhash.similarities(pairs, 0.8, exact=False)
    assert ((got >= 0) == (quick >= 0)).all() and (quick <= got + 1e-12).all()
    for (a, b), x in zip(pairs, got, strict=True):
        want = 1 - edits(a.tolist(), b.tolist()) / max(len(a), len(b))
        assert abs(x - want) < 1e-9 if want >= 0.8 else x == -1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, content string, doc string")


def test_near_copies(spark):
    r = random.Random(5)
    vocab = [f"word{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(30, 200))] for _ in range(40)]
    rows, group = [], []
    for k, words in enumerate(base):
        for copy in range(r.choice([1, 1, 2, 5]) if k else 300):
            w = list(words)
            for _ in range(int(len(w) * r.choice([0, 0.02, 0.08])) if copy else 0):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
            rows.append((len(rows), text.upper() + "!" if r.random() < 0.1 else text, "x", "y"))
            group.append(k)
    got = {x["doc_id"]: x["class_id"] for x in orderminhash.classes(documents(spark, rows)).collect()}
    first = {}
    for i, k in enumerate(group):
        first.setdefault(k, i)
    assert [got[i] for i in range(len(rows))] == [first[k] for k in group]
    kept = orderminhash.one_of_each(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "content", "doc"]
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(got.values()))


def test_copies_with_many_tables_agree_with_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    known = orderminhash._Plain()
    words = {d: orderminhash.word_hashes(t, known) for d, t in texts.items()}
    ids = sorted(words)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i)]
    found = orderminhash.similarities([(words[ids[i]], words[ids[j]]) for i, j in pairs], 0.8)
    want = roots(len(ids), [p for p, s in zip(pairs, found, strict=True) if s >= 0])
    got = {x["doc_id"]: x["class_id"] for x in orderminhash.classes(docs).collect()}
    assert [got[d] for d in ids] == [ids[x] for x in want]


def test_odd_texts(spark):
    rows = [(1, None, "", ""), (2, None, "", ""), (3, "", "", ""), (4, "", "", ""), (5, "a b", "", ""), (5, "a b", "", ""), (6, "a b", "", ""), (None, "a b", "", ""), (7, "a " * 30_000, "", ""), (8, "a " * 29_000, "", "")]
    got = sorted((r["doc_id"] or -1, r["class_id"]) for r in orderminhash.classes(documents(spark, rows)).collect())
    assert got == [(-1, None), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (5, 5), (6, 5), (7, 7), (8, 7)]
    assert sorted(r["doc_id"] or -1 for r in orderminhash.one_of_each(documents(spark, rows)).collect()) == [-1, 1, 2, 3, 5, 7]
    assert orderminhash.classes(documents(spark, [])).count() == 0


def repeats_by_force(rows, window):
    first, words = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), d), d)
    out = []
    for d, w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((d if d is not None else -1, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    passages = [[r.choice(vocab) for _ in range(r.randint(45, 140))] for _ in range(6)]
    rows = []
    for d in range(250):
        w = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            w += p[(a := r.randint(0, 40)) : a + r.randint(20, 130)] if r.random() < 0.7 else [r.choice(vocab) for _ in range(r.randint(1, 40))]
            w += ["x"] * r.randint(1, 150) if r.random() < 0.1 else []
        rows.append((d if r.random() < 0.95 else 7, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \n"), (None, rows[0][1]), (403, rows[5][1]), (403, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("content", F.lit("x"))
    got = sorted((r[0] if r[0] is not None else -1, *tuple(r)[1:]) for r in seedextend.without_repeats(docs, digest=True).collect())
    assert got == repeats_by_force(rows, 50)
    plain = {r["doc_id"]: r["text"] for r in seedextend.without_repeats(docs).where("doc_id < 400 and doc_id <> 7").collect()}
    whole = seedextend.cleaned(docs)
    assert whole.columns == docs.columns
    assert all(" ".join(r["text"].split()) == plain[r["doc_id"]] for r in whole.where("doc_id < 400 and doc_id <> 7").collect())
    assert seedextend.without_repeats(docs.limit(0)).count() == 0


def test_a_text_joins_a_large_part_by_its_only_link(spark):
    """All texts are in the one bucket; the one that the last links to has fewer words in common with it than 20 others, which don't reach the threshold for their order."""
    base = [f"p4w{i}" for i in range(100)]
    near = [[f"x{i}"] + base[1:] for i in range(20)]
    last = base[:39] + ["s"] + base[40:62][::-1] + ["t"] + base[63:]
    link = base[:8] + ["y1", "y2", "y3"] + base[11:40] + last[40:44] + base[44:58] + last[58:62] + base[62:]
    assert edits(last, link) <= 20 < min(edits(last, x) for x in near[:3]) and edits(link, near[0]) <= 20
    rows = [(i, " ".join(x), "", "") for i, x in enumerate([*near, link, last])]
    assert {x["class_id"] for x in orderminhash.classes(documents(spark, rows), tables=1, short_tables=0).collect()} == {0}


def test_edits_at_the_threshold_are_met():
    """Isolated pairs at similarity 0.8 and a little more, with edits evenly spaced or at random, and short texts with one word changed."""
    r = np.random.default_rng(8)
    met = {}
    for n in (5, 6, 8, 9, 10, 11, 15, 20, 21, 22, 25, 30, 40, 100, 127, 128, 129, 200, 500):
        for how in ("even", "random"):
            edited = n // 5
            found = 0
            for _ in range(60):
                a = r.integers(1, 1 << 62, n).astype(np.uint64)
                b = a.copy()
                at = (np.arange(edited) * n / edited + n / edited / 2).astype(int) if how == "even" else r.choice(n, edited, replace=False)
                b[at] = r.integers(1 << 62, 1 << 63, len(at)).astype(np.uint64)
                if how == "random" and n % 2:  # words are taken out and put in too, as many
                    b = np.insert(np.delete(a, r.integers(n)), r.integers(n - 1), b[at[:1]]) if edited > 1 else np.delete(a, r.integers(n))
                found += len(np.intersect1d(orderminhash.buckets_of(a), orderminhash.buckets_of(b))) > 0
            met[n, how] = found / 60
    assert min(met.values()) >= 0.88, met


def test_short_texts_of_frequent_words_hardly_meet():
    """Nothing here is a near duplicate; what meets must not grow with the square of the number of texts."""
    r = np.random.default_rng(9)
    share = 1 / np.arange(1, 50_001)
    places = np.cumsum(share / share.sum())
    words = r.integers(0, 1 << 62, 50_000).astype(np.uint64)
    for low, high in ((5, 9), (12, 20)):
        for n in (4000, 8000):
            keys = [np.unique(orderminhash.buckets_of(words[np.searchsorted(places, r.random(int(r.integers(low, high + 1)))).clip(0, 49_999)])) for _ in range(n)]
            counts = np.unique(np.concatenate(keys), return_counts=True)[1]
            assert (counts * (counts - 1) // 2).sum() < 0.05 * n


def test_one_edit_keys_find_each_other():
    r = np.random.default_rng(10)
    for n in range(1, 10):
        for _ in range(50):
            a = r.integers(0, 1 << 62, n).astype(np.uint64)
            at, new = int(r.integers(n)), r.integers(0, 1 << 62, 1).astype(np.uint64)
            others = [a, np.r_[a[:at], new, a[at + 1 :]], np.r_[a[:at], new, a[at:]], *([np.delete(a, at)] if n > 1 else [])]
            assert all(len(np.intersect1d(orderminhash.one_edit_keys(a), orderminhash.one_edit_keys(b))) for b in others)
            assert not len(np.intersect1d(orderminhash.one_edit_keys(a), orderminhash.one_edit_keys(r.integers(0, 1 << 62, n + 1).astype(np.uint64))))


def test_short_texts_that_differ_in_one_word(spark):
    base = "one two three four five six seven eight".split()
    rows = [(i, " ".join(base[:4] + [f"x{i}"] + base[5:]), "", "") for i in range(20)]
    assert {x["class_id"] for x in orderminhash.classes(documents(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_classes_do_not_depend_on_blocks(spark, block, monkeypatch):
    """Texts of two sizes with a passage in common, which all buckets of the passage hold, and chains of near copies; links by all pairs that share a bucket."""
    monkeypatch.setattr(orderminhash, "BLOCK", block)
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(40)]
    rows, words = [], []
    for k in range(30):
        own = [r.choice(vocab) for _ in range(r.choice([20, 60]))]
        for _ in range(r.choice([1, 3])):
            words.append(passage + own)
            own = list(own)
            for _ in range(len(own) // 6):
                own[r.randrange(len(own))] = r.choice(vocab)
    rows = [(i, " ".join(w), "", "") for i, w in enumerate(words)]
    known = orderminhash._Plain()
    hashed = [orderminhash.word_hashes(x[1], known) for x in rows]
    keys = [set(orderminhash.buckets_of(x).tolist()) for x in hashed]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if keys[i] & keys[j]]
    near = [p for p, s in zip(pairs, orderminhash.similarities([(hashed[i], hashed[j]) for i, j in pairs], 0.8), strict=True) if s >= 0]
    got = {x["doc_id"]: x["class_id"] for x in orderminhash.classes(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == roots(len(rows), near)


def test_bounds_of_long_texts():
    """Halves that are swapped have all words in common, and are refused at once; evenly edited copies are accepted by their anchors."""
    r = np.random.default_rng(4)
    a = orderminhash.mix((r.zipf(1.2, 200_000) % 30_000).astype(np.uint64))
    b = np.delete(a, r.choice(len(a), 8_000, replace=False))
    b[r.choice(len(b), 12_000, replace=False)] = 7
    swapped = np.r_[a[100_000:], a[:100_000]]
    far, near = orderminhash.similarities([(a, swapped), (a, b)], 0.8, exact=False)
    assert far == -1 and 0.8 <= near <= 0.91
    for _ in range(40):
        x = r.integers(0, 12, 60).astype(np.uint64)
        y = np.delete(x, r.choice(60, 5, replace=False))
        y[r.choice(55, 4, replace=False)] = 99
        least = edits(x.tolist(), y.tolist())
        assert orderminhash._edits_by_anchors(x, y, 3) >= least and not orderminhash._too_far(x, y, least)


@pytest.mark.parametrize("names", [("id", "void"), ("row", "nth"), ("kept_key", "kept_content"), ("component", "class_id"), ("first", "lo")])
def test_clashing_names_in_near_copies(spark, names):
    rows = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "a b c", "x", "y"), (3, "d e", "x", "y"), (None, "d e", "x", "y")], f"doc_id long, text string, {names[0]} string, {names[1]} string")
    got = orderminhash.one_of_each(rows)
    assert got.schema == rows.schema and sorted(map(str, got.collect())) == sorted(map(str, rows.where("doc_id is null or doc_id <> 2").collect()))


def test_a_repeated_word_changes_only_its_own_label():
    words = orderminhash.mix(np.arange(40, dtype=np.uint64))
    for k in (1, 3, 5):
        plain, again = (set(orderminhash.labelled_runs(x, k).tolist()) for x in (words, np.r_[words, words[:6]]))
        assert plain < again
