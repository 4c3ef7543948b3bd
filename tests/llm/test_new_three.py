"""Delta Lloyd, word BPE and the Merkle manifest against plain forms of themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import deltalloyd, merkle, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as file:
        return wordbpe.WordBpe(file.read())


PARTS = ["a", "b", " ", "\n", "\x1c", "\x85", "\xa0", "　", "1", "é", "é", "漢", "😀", "ing", "the", "  ", "!", "᠎", "​", "²", "Ⅷ", "\t", "'s", "'", "'re", "really"]
PARTS += ["'ll", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "Σ", "ΑΣ", "Ᲊ", "՘", "\U00010d50", "...", "''''", "́"]


def test_word_bpe_equals_the_library_wherever_a_text_is_cut(library, bpe):
    r = random.Random(1)
    for n in range(3000):
        pool = PARTS if n % 3 else r.sample(PARTS, 3)
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.encode(text, leaf=r.choice([1, 2, 3, 5, 8, 20])) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 15_000, "=-" * 15_000, "'" * 20_000, "a'll" * 9000, "漢字かな" * 5000, "x" * 17_001 + " " + "é" * 17_001, "the cat's <|endoftext|> " * 2000])
def test_word_bpe_of_long_unsplit_texts(library, bpe, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert all(bpe.encode(text, leaf) == want for leaf in (wordbpe.LEAF, 1000, 37))


def test_word_bpe_tables(spark, library):
    long = "thequickbrown" * 400 + " and more, it's " * 300
    rows = [(1, "Hello World"), (2, None), (3, ""), (4, " \n"), (5, long), (5, long), (None, "É" * 3000), (6, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("of", F.lit(2)).withColumn("part", F.lit("x"))
    want = sorted((k or 0, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows)
    ids = wordbpe.encode(docs, PATH, leaf=500)
    assert sorted((r[0] or 0, r[1]) for r in ids.collect()) == want
    texts = wordbpe.decode(ids, PATH)
    assert sorted((r[0] or 0, r[1]) for r in texts.collect()) == [(k, library.decode(i, skip_special_tokens=False)) for k, i in want]
    digests = lambda i: (len(i), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, i)), library.decode(i, skip_special_tokens=False))))
    for leaf in (500, wordbpe.LEAF):
        assert sorted((r[0] or 0, *r[1:]) for r in wordbpe.round_trip(docs, PATH, leaf=leaf).collect()) == [(k, *digests(i)) for k, i in want]
    assert wordbpe.round_trip(docs.limit(0), PATH).count() == 0


def lloyd(vectors, start, rounds):
    """Plain rounds over Python's integers."""
    at = [list(x) for x in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        owners = [near(v)[1] for v in vectors]
        for n in range(len(at)):
            if own := [v for v, o in zip(vectors, owners) if o == n]:
                at[n] = [sum(x) // len(own) for x in zip(*own)]
    return [near(v)[::-1] for v in vectors], at


@pytest.mark.parametrize("size", [1.0, 3e4, 2e6])
def test_delta_lloyd_against_plain_rounds(spark, size):
    r = np.random.default_rng(3)
    given = np.concatenate([r.normal(size=(150, 4)) * size, np.zeros((20, 4)), np.round(r.normal(size=(60, 4)))])
    rows = [(n, [float(y) for y in x]) for n, x in enumerate(given)]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1e12, 0.0, 0.0, 0.0]), (906, [])]
    table = spark.createDataFrame(rows + rows[:5] + odd, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("cluster", F.lit("x"))
    kept = rows + rows[:5]
    whole = [[int(np.floor(1024 * x)) for x in v] for _, v in kept]
    order = sorted((hashlib.sha256(f"3:{k}".encode()).hexdigest(), v) for (k, _), v in zip(kept, whole))
    want, centroids = lloyd(whole, [v for _, v in order[:6]], 5)
    found, got = deltalloyd.cluster(table.repartition(5), k=6, rounds=5, dim=4)
    assert got == centroids
    assert sorted(tuple(x) for x in found.collect()) == sorted((k, c, min(d, deltalloyd.LONGEST)) for (k, _), (c, d) in zip(kept, want))


def test_delta_lloyd_of_few_and_no_vectors(spark):
    table = spark.createDataFrame([(None, [0.5, 1.0]), (7, [0.5, 1.0])], "vec_id long, embedding array<float>")
    found, at = deltalloyd.cluster(table, k=8, dim=2)
    assert at == [[512, 1024]] * 2 and sorted((r[0] or 0, r[1], r[2]) for r in found.collect()) == [(0, 0, 0), (7, 0, 0)]
    whole = deltalloyd.described(found, at).collect()
    assert {(r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in whole} == {(0, 0, hashlib.sha256(b"512,1024").hexdigest())}
    found, at = deltalloyd.cluster(table.limit(0), dim=2)
    assert found.count() == 0 == deltalloyd.described(found, at).count()


def test_only_moved_centroids_are_compared():
    vectors = np.array([[0, 0], [9, 9], [4, 4]])
    at, owner, far = np.array([[0, 1], [9, 8], [4, 4]]), np.array([0, 1, 0], np.int32), np.array([1, 1, 25])
    seen = []
    plain = deltalloyd.distances
    deltalloyd.distances = lambda v, c: seen.append((len(v), len(c))) or plain(v, c)
    try:
        new, near = deltalloyd.nearest(vectors, at, np.array([False, False, True]), owner, far)
    finally:
        deltalloyd.distances = plain
    assert seen == [(3, 1)] and new.tolist() == [0, 1, 2] and near.tolist() == [1, 1, 0]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proof_of(digests, at, fan=8):
    """The last node over digests, and the siblings of ``at`` from below, as (before, after)."""
    steps = []
    while len(digests) > 1:
        run = digests[at // fan * fan : at // fan * fan + fan]
        steps.append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        digests, at = [sha(*digests[n : n + fan]) for n in range(0, len(digests), fan)], at // fan
    return digests[0], steps


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest_rows(rows):
    """What op13's contract says of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: sha(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [proof_of([leaf(r) for r in groups[g]], 0)[0] for g in order]
    out = []
    for place, g in enumerate(order):
        leaves = [leaf(r) for r in groups[g]]
        root, above = proof_of(tops, place)
        for n, r in enumerate(groups[g]):
            steps = proof_of(leaves, n)[1] + above
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf((*r[:4], text))
            for before, after in steps:
                now = sha(before, now, after)
            out.append((r[0], leaves[n], tops[place], root, sha(*(a + b for a, b in steps)), now, now == root))
    return out


@pytest.mark.parametrize("n", [1, 9, 700])
def test_merkle_against_brute_force(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(n * 2), r.choice(["a", None]), r.choice(["en", "de", None, "é", "z" * 3, "", "fr", "it", "pt", "nl"][: 1 + n]) if n > 1 else "en", r.choice([None, 3]), r.choice([None, "", "Abc É", "x" * 5000, "abc"])) for _ in range(n)]
    rows += [(None, None, None, None, None)] * (n > 1) + rows[: n // 3]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("of", F.lit(1)).withColumn("number", F.lit("x")).withColumn("mark", F.lit(2))
    made = merkle.manifest(docs.repartition(3), "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": merkle.tampered_text(docs["doc_id"], docs["text"])})
    got = [tuple(x) for x in merkle.checked(made).collect()]
    assert sorted(got, key=repr) == sorted(manifest_rows(rows), key=repr)
    made.drop()


def test_merkle_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    made = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "text"])
    assert made.root is None and merkle.checked(made).count() == 0
