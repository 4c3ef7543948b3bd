"""BPE with word ends: exact encoding of texts of any length by tree concatenation, and decoding.

A text is brought to its normal form (composed, lower case, one space for each run of white space) and, where it is long,
cut into halves again and again, wherever the middle falls, inside words too. The parts are encoded in parallel by Spark
tasks. Then neighbours are joined pairwise up the tree: the last few tokens of the left side and the first few of the
right are decoded and encoded again as one window, and the window doubles on the side that doesn't agree until its first
token is the one that the left side has there, and its last piece the one that the right side has.

That is exact. A sequence of tokens is what merging by rank gives for their joined bytes if this holds for each two that
stand side by side, since the first merge across a border would also happen between these two alone. The pairs outside
the window, and those at its two edges, are as they were. Windows begin and end where the splitting of the text is certain
on its own: at the start of a piece that no character beyond the cut can change, or deep within a run of one kind.

``Sides`` of a join are lists of ids in which -1 is a space, so that they hold their own text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from operator import itemgetter

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, whole_groups, written

#: A text of more characters is cut into halves until they have no more.
LEAF = 1 << 15
#: A run of one kind of character is certain to go on after so many bytes of it.
DEEP = 16
#: Words that a process remembers, and as many older ones; about 0.1 GB.
REMEMBERED = 250_000
SPACE = -1


def letters_of_bytes() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others by number from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary: ``spec`` is the JSON text of its file."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        # normal form and kinds of characters by the library's own Unicode tables, with no vocabulary behind them
        bare = tokenizers.Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": [], "end_of_word_suffix": None}}))
        self.normal = bare.normalizer.normalize_str
        self.split = bare.pre_tokenizer[0].pre_tokenize_str
        plain = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.plain_pieces = re.compile(plain, re.ASCII).findall
        self.plain_spaced = re.compile(" |" + plain, re.ASCII).findall
        vocab, letter = model["vocab"], letters_of_bytes()
        self.first = [vocab[letter[b]] for b in range(256)]
        self.last = [vocab[letter[b] + self.suffix] for b in range(256)]
        pairs = [tuple(p.split(" ") if isinstance(p, str) else p) for p in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.union = [vocab[a + b] for a, b in pairs]
        byte = {c: b for b, c in enumerate(letter)}
        self.shown = {i: token for token, i in vocab.items()}
        self.final = {i for token, i in vocab.items() if token.endswith(self.suffix)}
        self.bytes_of = {i: bytes(byte[c] for c in (token[: -len(self.suffix)] if i in self.final else token)) for token, i in vocab.items() if set(token) <= byte.keys()}
        # a special token within a text that is in normal form is a surrogate, which no text has
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.stands = {chr(0xD800 + n): i for n, i in enumerate(self.special.values())}
        self.shown |= {i: token for token, i in self.special.items()}
        self.final |= set(self.special.values())
        self.bytes_of |= {i: c.encode("utf-8", "surrogatepass") for c, i in self.stands.items()}
        self.bytes_of[SPACE] = b" "
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.decimal = {i: b"%d" % i for i in self.shown}
        self.utf8 = {i: token.encode() for i, token in self.shown.items()}
        self.words, self.known = _Words(self), _Chunks(self)

    def piece(self, data: bytes, ends: bool = True) -> list[int]:
        """Tokens of one piece; without ``ends``, of the beginning of one that goes on."""
        ids = list(map(self.first.__getitem__, data))
        if ends:
            ids[-1] = self.last[data[-1]]
        rank, union, n, none = self.rank, self.union, len(ids), len(self.union)
        if n < 48:
            ranks = list(map(rank.get, zip(ids, ids[1:]), repeat(none)))
            while ranks and (least := min(ranks)) < none:
                at = ranks.index(least)
                ids[at] = union[least]
                del ids[at + 1], ranks[at]
                if at < len(ranks):
                    ranks[at] = rank.get((ids[at], ids[at + 1]), none)
                if at:
                    ranks[at - 1] = rank.get((ids[at - 1], ids[at]), none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], at, *pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            least, at, a, b = heapq.heappop(heap)
            right = after[at]
            if ids[at] != a or right >= n or ids[right] != b:
                continue
            ids[at], ids[right] = union[least], None
            after[at] = follows = after[right]
            if follows < n:
                before[follows] = at
                if (pair := (ids[at], ids[follows])) in rank:
                    heapq.heappush(heap, (rank[pair], at, *pair))
            if (prior := before[at]) >= 0 and (pair := (ids[prior], ids[at])) in rank:
                heapq.heappush(heap, (rank[pair], prior, *pair))
        return [i for i in ids if i is not None]

    def sections(self, text: str) -> list[str]:
        """A text cut at special tokens, which stand between the sections, at odd places."""
        return self.specials.split(text) if self.specials and "<" in text else [text]

    def normalised(self, text: str) -> str:
        """The normal form of a whole text, with a surrogate for each special token."""
        marks = {token: c for c, i in self.stands.items() for token, j in self.special.items() if i == j}
        found = self.sections(text)
        for n, section in enumerate(found):
            found[n] = marks[section] if n % 2 else re.sub(" +", " ", section.translate(_BLANKS).lower()) if section.isascii() else self.normal(section)
        return "".join(found)

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a part of a text in normal form without spaces and surrogates."""
        return self.plain_pieces(chunk) if chunk.isascii() else [x for x, _ in self.split(chunk)]

    def side(self, text: str, ends: bool = True) -> list[int]:
        """Ids and spaces of a text in normal form; without ``ends``, of one whose last piece goes on."""
        words, out = self.words, []
        if text.isascii():
            out = list(chain.from_iterable(map(words.ids, self.plain_spaced(text))))
        else:
            for n, chunk in enumerate(text.split(" ")):
                if n:
                    out.append(SPACE)
                for part in _SURROGATE.split(chunk) if chunk and not chunk.isascii() else (chunk,):
                    if part in self.stands:
                        out.append(self.stands[part])
                    elif part:
                        out.extend(chain.from_iterable(map(words.ids, self.pieces(part))))
        if not ends and out and out[-1] in self.final and out[-1] not in self.special.values():
            at = self.begin(out, len(out) - 1)
            out[at:] = self.piece(self.data(out[at:]), False)
        return out

    def described(self, ids: list[int]) -> tuple[tuple[int, ...], bytes, bytes]:
        """Ids, their decimals and their decoding, as rows of results are made of."""
        return tuple(ids), b" ".join(map(self.decimal.__getitem__, ids)), b" ".join(map(self.utf8.__getitem__, ids))

    def data(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def begin(self, side: list[int], at: int) -> int:
        """Where the piece of the token ``at`` begins."""
        while at and side[at - 1] != SPACE and side[at - 1] not in self.final:
            at -= 1
        return at

    def deep(self, side: list[int], at: int) -> bool:
        """Whether the token ``at`` begins with a character deep within a run, where a window may begin or end."""
        if side[at] == SPACE or side[at - 1] == SPACE or side[at - 1] in self.final:
            return False
        data, seen, n = self.bytes_of[side[at]], 0, at
        while n and seen < DEEP and side[n - 1] != SPACE and side[n - 1] not in self.final:
            n -= 1
            seen += len(self.bytes_of[side[n]])
        return seen >= DEEP and data[0] & 0xC0 != 0x80 and data[:1] != b"'"

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """What side() gives for the text of both."""
        if not left or not right:
            return left or right
        take_left = take_right = 4
        while True:
            x = max(0, len(left) - take_left)
            starts = sum(left[n] != SPACE and self.begin(left, n) == n for n in range(x, len(left))) if x else 0
            while x and not (self.deep(left, x) or left[x] != SPACE and starts > 1 and self.begin(left, x) == x):
                x -= 1
                starts += left[x] != SPACE and (not x or left[x - 1] == SPACE or left[x - 1] in self.final)
            y = min(take_right, len(right))
            while y < len(right) and not (right[y - 1] in self.final or self.deep(right, y)):
                y += 1
            whole = y == len(right) or right[y - 1] in self.final
            window = self.side(self.data(left[x:] + right[:y]).decode("utf-8", "surrogatepass"), ends=whole)
            agree_left = not x or window[0] == left[x]
            if y == len(right):
                agree_right = True
            elif whole:
                agree_right = window[self.begin(window, len(window) - 1) :] == right[self.begin(right, y - 1) : y]
            else:
                agree_right = window[-1] == right[y - 1]
            if agree_left and agree_right:
                return left[:x] + window + right[y:]
            take_left = take_left if agree_left else 2 * (len(left) - x)
            take_right = take_right if agree_right else 2 * y

    def concatenated(self, sides: list[list[int]]) -> list[int]:
        """The tree over 2^k neighbouring sides."""
        while len(sides) > 1:
            sides = [self.join(a, b) for a, b in zip(sides[::2], sides[1::2])]
        return [i for i in sides[0] if i != SPACE]

    def halves(self, text: str, leaf: int = LEAF) -> list[str]:
        """A text in normal form, cut into halves until they have no more than ``leaf`` characters."""
        n = 1 << max(0, (len(text) - 1) // leaf).bit_length()
        return [text[i * len(text) // n : (i + 1) * len(text) // n] for i in range(n)]

    def encode(self, text: str | None, leaf: int = LEAF) -> list[int]:
        """The tokens of a text, all in this process."""
        if text and len(text) > leaf:
            return self.concatenated([self.side(x) for x in self.halves(self.normalised(text), leaf)])
        return [i for chunk in chunks(text) for i in self.known[chunk][0]] if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens as they are shown, with spaces between them."""
        return " ".join(map(self.shown.__getitem__, ids))


#: White space within ASCII; str.split() without arguments would also split at U+001C to U+001F, which are none here.
_BLANKS = str.maketrans("\t\n\v\f\r", "     ")
_ODD = re.compile("[\x1c-\x1f]")
_SURROGATE = re.compile("([\ud800-\udfff])")
#: Up to here every letter is in composed form, and no later version of Unicode changes what is one.
LATIN_ENDS = "\u0250"


def chunks(text: str) -> list[str]:
    """The parts of a text between white space; no piece reaches over it, and normal forms don't either."""
    return regex.split(r"\p{White_Space}+", text) if _ODD.search(text) else text.split()


class _Remembered(dict):
    """Text -> (ids, their decimals, their decoding). Of what was met long ago only what came again since is kept: that costs time, never results."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.older = bpe, {}

    def __missing__(self, text: str):
        found = self.older.get(text) or self.find(text)
        if len(text) < 64:  # longer ones are rare, and would make the cache large
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class _Words(_Remembered):
    """By piece of a normal form; a space is its mark."""

    def find(self, piece: str):
        return self.bpe.described(self.bpe.piece(piece.encode())) if piece != " " else ((SPACE,), b"", b"")

    def ids(self, piece: str) -> tuple[int, ...]:
        return self[piece][0]


class _Chunks(_Remembered):
    """By chunk of a text as it stands."""

    def find(self, chunk: str):
        bpe = self.bpe
        low = chunk.lower() if chunk.isalpha() and max(chunk) < LATIN_ENDS else ""
        if low.isalpha():  # a word of letters that are in composed form, and whose lower case is too
            return self[low] if low != chunk else bpe.described(bpe.piece(low.encode()))
        if chunk.isascii() and "<" not in chunk:
            parts = list(map(bpe.words.__getitem__, bpe.plain_pieces(chunk.lower())))
            return parts[0] if len(parts) == 1 else (tuple(chain.from_iterable(map(itemgetter(0), parts))), b" ".join(map(itemgetter(1), parts)), b" ".join(map(itemgetter(2), parts)))
        return bpe.described([i for i in bpe.side(bpe.normalised(chunk)) if i != SPACE])


_READY: dict[str, WordBpe] = {}


def ready(spec: str, name: str) -> WordBpe:
    """One encoder for each vocabulary and Python process."""
    if name not in _READY:
        _READY[name] = WordBpe(spec)
        gc.disable()  # what is remembered holds no cycles, and looking for some takes a tenth of the time
    return _READY[name]


#: Columns of results, and what gives them from (ids, decimals, decoding) of each chunk.
_IDS = pa.list_(pa.int32())
_DIGESTS = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]


def _digests(found: list) -> tuple[int, str, str]:
    ids, decimals, decoded = zip(*filter(itemgetter(0), found)) if found else ((), (), ())
    return sum(map(len, ids)), hashlib.sha256(b" ".join(decimals)).hexdigest(), hashlib.sha256(b" ".join(decoded)).hexdigest()


def _ids(found: list) -> tuple[list[int]]:
    return (list(chain.from_iterable(map(itemgetter(0), found))),)


def _encoded(df: DataFrame, path: str, text: str, key: str, leaf: int, columns: list, give) -> DataFrame:
    """(key, columns): ``give`` makes a row's columns from a list of (ids, decimals, decoding) that make up its text.

    The first pass encodes texts of up to ``leaf`` characters and gives the halves of others as rows of their own, which
    other tasks encode; a task then has one text's sides at a time, in order, and joins them. Only where some text is long.
    """
    with open(path, encoding="utf-8") as file:
        # 2 MB, as the file; read here, since executors needn't have it
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    name, names = path, [c[0] for c in columns]
    empty = [pa.nulls(1, c[1]) for c in columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(spec.value, name)
        for batch in batches:
            for rows in slices(batch):
                at, done, parts, numbers = [], [], [], []
                for n, x in enumerate(rows.column(2).to_pylist()):
                    if x and len(x) > leaf:
                        halves = bpe.halves(bpe.normalised(x), leaf)
                        at += [n] * len(halves)
                        done += [None] * len(halves)
                        numbers += range(len(halves))
                        parts += [h.encode("utf-8", "surrogatepass") for h in halves]
                    else:
                        at.append(n)
                        done.append(give(list(map(bpe.known.__getitem__, chunks(x))) if x else []))
                        numbers.append(None)
                        parts.append(None)
                whose = rows.take(pa.array(at, pa.int64()))
                given = [pa.array([d and d[i] for d in done], c[1]) for i, c in enumerate(columns)]
                yield pa.record_batch([whose.column(0), whose.column(1), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary()), *given], ["key", "of", "part", "half", *names])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(spec.value, name)
        for batch in batches:
            for rows in slices(batch):
                found = [bpe.side(x.decode("utf-8", "surrogatepass")) for x in rows.column(3).to_pylist()]
                yield pa.record_batch([*rows.columns[:3], pa.array(found, _IDS)], ["key", "of", "part", "side"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(spec.value, name)
        for table, starts, ends in whole_groups((s for b in batches for s in slices(b)), ("of",)):
            lists = table.column("side").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(starts, ends):
                ids = bpe.concatenated([flat[edges[i] : edges[i + 1]].tolist() for i in range(a, b)])
                found = give([bpe.described(ids)])
                yield pa.record_batch([table.column("key").slice(a, 1).combine_chunks(), *(pa.array([x], c[1]) for x, c in zip(found, columns))], ["key", *names])

    rows = df.select(df[key].alias("key"), F.monotonically_increasing_id().alias("of"), df[text].alias("text"))
    kind = f"key {rows.schema['key'].dataType.simpleString()}"
    given = ", ".join(f"{c[0]} {c[2]}" for c in columns)
    first = written(mapped(rows, cut, f"{kind}, of long, part int, half binary, {given}"), "wordbpe")
    short = first.where("part is null").select("key", *names)
    long = first.where("part is not null").select("key", "of", "part", "half")
    if not long.isEmpty():
        spread = mapped(long.repartition("of", "part"), sides, f"{kind}, of long, part int, side array<int>")
        short = short.union(mapped(spread.repartition("of").sortWithinPartitions("of", "part"), joined, f"{kind}, {given}"))
    return short.withColumnRenamed("key", key)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """(key, ids array<int>): the tokens of every text, as the tokenizers library gives them without its extra special tokens; a special token's own string in a text is that token.

    A null or empty text gives an empty array; rows are kept as they are, repeated ones too, and null keys; texts of any
    length are encoded whole; an empty table gives no rows. Other columns are left out, so their names can't clash.
    """
    return _encoded(df, path, text, key, leaf, [("ids", _IDS, "array<int>")], _ids)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes its ids again, and gives the digests of both; odd rows are as in encode(), and texts without tokens have the digests of no bytes."""
    return _encoded(df, path, text, key, leaf, _DIGESTS, _digests)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text string): the decoding of every list of ids: tokens with their word ends, a space between each two. A null list gives an empty text, and so does an empty one. Other columns are left out, so their names can't clash."""
    with open(path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(spec.value, path)
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column(0), pa.array([bpe.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())], ["key", "text"])

    rows = df.select(df[key].alias("key"), df[ids].alias("ids"))
    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
