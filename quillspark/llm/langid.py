"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's bytes in windows, one forwards and one backwards; at every byte a softmax over both states labels
the position, and a document's probabilities are the mean over all its positions. The network is trained here, in numpy,
by backpropagation through time: every position of a training window has the document's language as its label, and Adam
takes the steps. Arrays have the windows in the last dimension, so that gates are contiguous.

Beside the languages there is a class of what is in none of them. It is learned from windows that are made for it: bytes of
true windows in disorder, letters of scripts that the labelled texts don't use, and what programs look like. It never names a language; a text whose positions have it for the greater part is in none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, sampled, slices

WINDOW = 64
HIDDEN = 8
STEPS = 400
BATCH = 192
#: At most so many labelled documents are learned from, in equal shares of each language, of each a passage of at most PASSAGE characters.
SAMPLE = 4000
PASSAGE = 400
UNKNOWN = "und"
#: Share of the windows of a step that are made for the class of no language.
OTHERS = 0.2
#: A text is in none of the learned languages if that class has more of its positions' probability than this, whatever their number: short held-out
#: texts of the given tables had up to 0.9 (a secret, an address, a line of a licence in another English), scripts and programs that weren't learned 0.998.
NONE = 0.98
LETTER = regex.compile(r"\p{L}")

# Letters of scripts by their first and last code point, and the marks of programs.
SCRIPTS = ((0x61, 0x7A), (0x391, 0x3C9), (0x410, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x985, 0x9B9), (0xB85, 0xBB9), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1200, 0x1248), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
MARKS = "(){}[];=<>+-*/.,:\"'#&|!_\n\t"


class Gru(NamedTuple):
    """Weights of one direction: the inputs' part for each byte value (with biases), and the state's part."""

    byte: np.ndarray
    state: np.ndarray


class Model(NamedTuple):
    """langs, and weights whose last class is that of no language."""

    langs: tuple[str, ...]
    forward: Gru
    backward: Gru
    out: np.ndarray
    bias: np.ndarray


def _logistic(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _states(gru: Gru, windows: np.ndarray, steps: range, keep: list | None = None) -> np.ndarray:
    """States at every position, (position, unit, window). keep: gets what backpropagation needs."""
    n, h2 = gru.state.shape[1], 2 * gru.state.shape[1]
    state = np.zeros((n, windows.shape[1]), np.float32)
    out = np.empty((len(windows), n, windows.shape[1]), np.float32)
    for t in steps:
        a = gru.byte.take(windows[t], axis=1)
        c = gru.state @ state
        gates = _logistic(a[:h2] + c[:h2])
        z, r = gates[:n], gates[n:]
        new = np.tanh(a[h2:] + r * c[h2:])
        if keep is not None:
            keep.append((t, state, z, r, new, c[h2:]))
        state = new + z * (state - new)
        out[t] = state
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-2, keepdims=True)
    return x


def _grads(gru: Gru, windows: np.ndarray, kept: list, d_states: np.ndarray) -> Gru:
    """Gradients of one direction, by going back through its steps."""
    n = gru.state.shape[1]
    d_state = np.zeros_like(gru.state)
    d_inputs = np.empty((len(windows), 3 * n, windows.shape[1]), np.float32)
    carry = np.zeros((n, windows.shape[1]), np.float32)
    for t, before, z, r, new, c in reversed(kept):
        d = d_states[t] + carry
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * c * r * (1 - r)
        d_inputs[t] = np.concatenate([d_z, d_r, d_new])
        d_c = np.concatenate([d_z, d_r, d_new * r])
        d_state += d_c @ before.T
        carry = d * z + gru.state.T @ d_c
    flat = d_inputs.transpose(1, 0, 2).reshape(3 * n, -1)
    at = windows.reshape(-1)
    return Gru(np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32), d_state)


def unused_scripts(texts: list[str]) -> list[tuple[int, int]]:
    """The scripts that have less than a hundredth of the texts' letters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    counts = np.array([((points >= a) & (points <= b)).sum() for a, b in SCRIPTS])
    return [x for x, n in zip(SCRIPTS, counts) if n < 0.01 * max(1, counts.sum())]


def unlike(rng: np.random.Generator, true: np.ndarray, scripts: list[tuple[int, int]], window: int) -> np.ndarray:
    """Bytes in no language, as many as a window has at most: a true window in disorder, another script, or what a program looks like."""
    kind = int(rng.integers(3))
    if kind == 0:
        return rng.permutation(true)
    if kind == 1 and scripts:
        first, last = scripts[int(rng.integers(len(scripts)))]
        letters = rng.integers(first, last + 1, size=min(40, last - first + 1))  # a text uses some letters often
        words = ("".join(map(chr, rng.choice(letters, int(rng.integers(1, 10))).tolist())) for _ in range(window // 4))
        return np.frombuffer((" " if rng.random() < 0.7 else "").join(words).encode()[:window], np.uint8)
    parts, size = [], 0
    while size < window:
        name = bytes(rng.integers(97, 123, size=int(rng.integers(1, 9))).tolist()) if rng.random() < 0.5 else b"%d" % rng.integers(1000) if rng.random() < 0.2 else b" "
        parts.append(name + MARKS[int(rng.integers(len(MARKS)))].encode())
        size += len(parts[-1])
    return np.frombuffer(b"".join(parts)[:window], np.uint8)


def train(texts: list[str], langs: list[str], window: int = WINDOW, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 11, others: float = OTHERS) -> Model | None:
    """A model from texts and their languages, both without nulls; the same for the same rows in the same order. None where there is no text."""
    names = tuple(sorted(set(langs)))
    rows = [(np.frombuffer(x.encode(), np.uint8), names.index(y)) for x, y in zip(texts, langs, strict=True) if LETTER.search(x)]
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
    params = [init(3 * hidden, 256), init(3 * hidden, hidden), init(3 * hidden, 256), init(3 * hidden, hidden), init(len(names) + 1, 2 * hidden), np.zeros((len(names) + 1, 1), np.float32)]
    scripts, n_others = unused_scripts([x for x in texts if LETTER.search(x)]), round(others * batch)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(len(rows), size=batch)
        x, y = np.zeros((window, batch), np.uint8), np.zeros(batch, np.int64)
        for i, p in enumerate(pick.tolist()):
            data, y[i] = rows[p]
            at = int(rng.integers(max(1, len(data) - window + 1)))
            part = data[at : at + window]
            if i < n_others:
                part, y[i] = unlike(rng, part, scripts, window), len(names)
            x[: len(part), i] = part
        ahead, back = Gru(params[0], params[1]), Gru(params[2], params[3])
        kept_f: list = []
        kept_b: list = []
        both = np.concatenate([_states(ahead, x, range(window), kept_f), _states(back, x, range(window - 1, -1, -1), kept_b)], axis=1)
        prob = _softmax(params[4] @ both + params[5])
        prob[:, y, np.arange(batch)] -= 1
        prob *= (x > 0)[:, None, :] / np.float32(window * batch)
        d_out = np.einsum("tkb,thb->kh", prob, both)
        d_both = params[4].T @ prob
        gf, gb = _grads(ahead, x, kept_f, d_both[:, :hidden]), _grads(back, x, kept_b, d_both[:, hidden:])
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, [*gf, *gb, d_out, prob.sum((0, 2))[:, None]], first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(names, Gru(params[0], params[1]), Gru(params[2], params[3]), params[4], params[5])


def _windows(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the bytes, and how many of each count: the last one ends with the text, and counts only what is new in it."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    if n <= window:
        out = np.zeros((1, window), np.uint8)
        out[0, :n] = x
        return out, np.array([n])
    whole = x[: n - n % window].reshape(-1, window)
    if not n % window:
        return whole, np.full(len(whole), window)
    return np.concatenate([whole, x[None, n - window :]]), np.r_[np.full(len(whole), window), n % window]


def positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (position, language, window) for windows of bytes (position, window)."""
    n = model.forward.state.shape[1]
    ahead = _states(model.forward, x, range(len(x)))
    back = _states(model.backward, x, range(len(x) - 1, -1, -1))
    return _softmax(model.out[:, :n] @ ahead + model.out[:, n:] @ back + model.bias)


def predict(model: Model | None, texts: list[str | None], window: int = WINDOW, at_once: int = 1024) -> list[tuple[str, float, float]]:
    """(language, its mean probability over all positions, that of no language) of each whole text; ('und', 0.0, 1.0) for null and for texts without a letter."""
    out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 1.0)] * len(texts)
    todo = [i for i, x in enumerate(texts) if x and model and LETTER.search(x)]
    if not todo:
        return out
    parts = [_windows(texts[i].encode(), window) for i in todo]
    owner = np.repeat(np.arange(len(todo)), [len(x[0]) for x in parts])
    windows, counts = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    short = np.concatenate([np.r_[np.zeros(len(x[0]) - 1, bool), x[1][0] < window and len(x[0]) == 1] for x in parts])
    total = np.zeros((len(model.langs) + 1, len(windows)))
    for at in range(0, len(windows), at_once):
        x = np.ascontiguousarray(windows[at : at + at_once].T)
        n, place = counts[at : at + at_once], np.arange(window)[:, None]
        counts_here = np.where(short[at : at + at_once], place < n, place >= window - n).astype(np.float32)
        prob = positions(model, x)
        prob *= counts_here[:, None, :]
        total[:, at : at + at_once] = prob.sum(0)
    pooled = np.stack([np.bincount(owner, row, len(todo)) for row in total]) / np.bincount(owner, counts, len(todo))
    best = pooled[:-1].argmax(0)
    for j, i in enumerate(todo):
        out[i] = (model.langs[best[j]], float(min(1.0, pooled[best[j], j])), float(min(1.0, pooled[-1, j])))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, passage: int = PASSAGE) -> Model | None:
    """A model from a bounded sample: up to ``sample`` different labelled rows, as many of each language where it has them, of each a passage from a place given by a hash.

    Which rows is decided by the hash of key and text; equal rows count as one, and null keys are a key. Rows without a
    label or a text, or without a letter in the passage, teach nothing; None where that leaves none.
    """
    place = F.xxhash64(F.lit("place"), docs[key], docs[text])
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull())
    start = F.pmod(place, F.greatest(F.length(docs[text]) - passage, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(place.alias("place"), docs[text].substr(start, F.lit(passage)).alias("text"), docs[lang].alias("lang"))
    rows = sampled(rows, "place", sample, by="lang").collect()
    rows.sort()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of ``keep``, lang_pred, score) of each row's whole text.

    A null text and one without a letter are 'und' with score 0, and so is every text where nothing could be learned;
    repeated rows give repeated results; no rows give no rows. Columns beside the key and ``keep`` are left out; ``keep`` can't hold lang_pred or score.
    """
    if {"lang_pred", "score"} & {key, *keep}:
        raise ValueError("lang_pred and score are columns of the result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                found = predict(model, part.column("lid_text").to_pylist())
                cols = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.record_batch([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    rows = docs.select(docs[text].alias("lid_text"), docs[key], *(docs[c] for c in keep))
    names = [*(f"c{i}" for i in range(len(rows.columns) - 1)), "lang_pred", "score"]
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[1:])]
    found = mapped(rows, run, ", ".join([*fields, "lang_pred string", "score double"]))
    return found.toDF(key, *keep, "lang_pred", "score")


def held_out(key):
    """Whether a document is kept from learning: CRC-32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spoken(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", none: float = NONE, langs: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs, with their columns, that are in a learned language, or with ``langs`` in one of these.

    Rejected are null texts and those without a letter, those in no language (the network gives that class over ``none`` on
    average over all positions), and with ``langs`` those with another label. Without a model, where nothing could be learned, only
    the first two; ``langs`` is an error then. Repeated rows are judged alike; other columns are carried along whatever their names.
    """
    if model is None and langs is not None:
        raise ValueError("no model: no row has a label and a text to learn from, so languages can't be told apart")
    at, names = docs.columns.index(text), docs.columns

    def kept(texts: list[str | None]) -> list[bool]:
        if model is None:
            return [bool(x and LETTER.search(x)) for x in texts]
        return [x != UNKNOWN and other <= none and (langs is None or x in langs) for x, _, other in predict(model, texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                yield part.filter(pa.array(kept(part.column(at).to_pylist()), pa.bool_())).rename_columns(names)

    return mapped(docs, run, docs.schema)
