"""Byte-level BPE: exact encoding in linear time, and decoding.

A byte is written as the Latin-1 character of the same number, so that an Aho-Corasick automaton over text finds every
vocabulary entry that matches at every byte of a piece in one scan. Encoding goes left to right, takes the longest match
that may stand after the token before it, falls back to its next shorter prefix in the vocabulary, and steps back one
token where none fits; a place from which no way leads on is never tried again. Two tokens may stand side by side when
merging their joined bytes by rank gives these two again; that is remembered per pair. A sequence whose neighbours are all
compatible is the one that merging by rank gives, so the result equals that of the merge loop.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE, mapped, slices


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file with a Base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merged(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The merge loop itself: the adjacent pair with the lowest rank is joined, leftmost first, until none can be."""
    parts = [data[i : i + 1] for i in range(len(data))]
    found = [ranks.get(a + b, 1 << 60) for a, b in pairwise(parts)]
    while found and (rank := min(found)) < 1 << 60:
        at = found.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        for i in (at - 1, at):  # the pairs that have the new part
            if 0 <= i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
    return [ranks[x] for x in parts]


class Codec:
    """Encoder and decoder for one vocabulary; every single byte must be in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pieces = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.vocab: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: b"%d" % rank for rank in self.vocab}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.automaton.make_automaton()
        self.length = {rank: len(token) for rank, token in self.vocab.items()}
        self.may_follow = Remembered(self.fits)
        self.known = Remembered(lambda piece: self.piece(piece.encode()), 64)  # longer ones are rare, and would make the cache large

    def fits(self, pair: tuple[int, int]) -> bool:
        return merged(self.ranks, self.vocab[pair[0]] + self.vocab[pair[1]]) == list(pair)

    def piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest, lengths, may_follow = [0] * n, self.length, self.may_follow
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank  # ends ascend, so of one place's matches the longest comes last
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            end = at + lengths[token]
            if end not in dead and (not out or may_follow[out[-1], token]):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text)))) if text else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class Remembered(dict):
    """What a function gave, in two generations: of what was met long ago only what came again since is kept. That costs time, never results. Keys of ``short`` parts and more aren't kept."""

    def __init__(self, find: Callable, short: int = 64) -> None:
        self.find, self.short, self.older = find, short, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(key) < self.short:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


_CODECS: dict[str, Codec] = {}


def codec_of(ranks: dict[bytes, int], pattern: str, name: str) -> Codec:
    """One codec for each vocabulary and Python process."""
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, pattern)
    return _CODECS[name]


def _shared(df: DataFrame, path: str, pattern: str):
    """The vocabulary, read on the driver and sent once to each executor; its size is that of the file (0.5 MB)."""
    return df.sparkSession.sparkContext.broadcast(load_ranks(path)), pattern, f"{path}|{pattern}"


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): the tokens of every text. A null or empty text gives an empty array; rows are kept as they are, repeated ones too, and null keys. Other columns are left out, so their names can't clash."""
    ranks, pattern, name = _shared(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern, name)
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column(0), pa.array([codec.encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["key", "ids"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, bytes binary): the bytes of every list of ids; a null list gives no bytes, and so does an empty one. Other columns are left out, so their names can't clash."""
    ranks, pattern, name = _shared(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern, name)
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column(0), pa.array([codec.decode(x or ()) for x in part.column(1).to_pylist()], pa.binary())], ["key", "bytes"])

    rows = df.select(df[key].alias("key"), df[ids].alias("ids"))
    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes its ids again, and gives the digests of both.

    The ids stay in the Python worker, so they don't cross to the JVM and back. Null and empty texts count no token and
    have the digests of no bytes; very long ones are encoded whole; repeated rows give repeated results; an empty table gives no rows.
    Other columns are left out, so their names can't clash.
    """
    ranks, pattern, name = _shared(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern, name)
        for batch in batches:
            for part in slices(batch):
                n, a, b = [], [], []
                for x in part.column(1).to_pylist():
                    ids = codec.encode(x)
                    n.append(len(ids))
                    a.append(hashlib.sha256(b" ".join(map(codec.decimal.__getitem__, ids))).hexdigest())
                    b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)

