"""Properties that hold for any input."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bytebpe, linerules, orderminhash, seedextend, warc

CODEC = bytebpe.Codec(bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_is_that_of_the_merge_loop(text):
    ids = CODEC.encode(text)
    assert CODEC.decode(ids) == text.encode()
    assert ids == [x for piece in CODEC.pieces(text) for x in bytebpe.merged(CODEC.ranks, piece.encode())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2**38 - 1)), max_size=4))
def test_covered_words(spans):
    keep = np.zeros(200, bool)
    for start, mask in spans:
        for i in range(38):
            if mask >> i & 1:
                keep[start + i : start + i + 50] = True
    assert (seedextend.covered(200, [{"start": s, "mask": m} for s, m in spans], 50) == keep).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_segments_hold_every_window_once(numbers):
    words = orderminhash.mix(np.array(numbers, np.uint64))
    _, _, start, count = seedextend.segments_of(words, 20, 6)
    windows = [s + i for s, n in zip(start.tolist(), count.tolist(), strict=True) for i in range(n)]
    assert windows == list(range(max(0, len(words) - 19)))
    assert all(n <= 15 for n in count)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_words(words):
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    assert linerules.repeated_words([w.encode() for w in words]) == len(often)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_page_makes_two_records(page):
    page = page.encode("utf-8", "replace").decode()
    for record in warc.derive_one("<urn:uuid:0>", payload=page.encode()):
        ((headers, block),) = warc.records(warc.serialised(record))
        assert block.decode() == record.block and headers["warc-refers-to"] == "<urn:uuid:0>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_alignment(a, b):
    x, y = np.array([*a, 9], np.uint64), np.array([*b, 9], np.uint64)
    row = list(range(len(y) + 1))
    for i, p in enumerate(x.tolist(), 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    want = 1 - row[-1] / max(len(x), len(y))
    (got,) = orderminhash.similarities([(x, y)], 0.5)
    assert abs(got - want) < 1e-9 if want >= 0.5 else got == -1
