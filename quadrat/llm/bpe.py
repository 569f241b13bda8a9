"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

Method. A piece of text (one match of the splitting pattern) is halved until a
half is a token or a byte. Two encoded neighbours are joined by encoding the
bytes of a window around their seam anew: the last k tokens of the left and
the first k of the right. A token sequence is the encoding of its bytes if and
only if every adjacent pair is the encoding of its own bytes: the first merge
that crosses a seam of the sequence would also happen in the two tokens at that
seam alone. So if the window keeps its outermost tokens, every pair outside it
is as valid as before, and the joined sequence is the encoding; otherwise the
window is doubled, at most to both sides whole. Joining is associative with the
empty sequence as its unit. Pieces are joined by concatenation; decoding
concatenates token bytes up the same kind of tree.

Rows. A null text is the empty text and has no tokens. Equal texts give equal
rows. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of, texts

#: Pieces whose ids a task remembers; it starts anew beyond.
REMEMBERED = 200_000
PIECES_REMEMBERED = 500_000
#: Characters of texts whose new pieces are encoded together.
CHUNK = 400_000
#: Bytes of a half that is not halved again; at up to 24, merging in place is faster than joining halves.
LEAF = 24
#: Above every rank.
NEVER = 1 << 60


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id from a rank file: one base64 token and its id per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def parse_tokenizer(data: bytes) -> dict[bytes, int]:
    """The same from a tokenizer file (JSON) of a byte-level BPE whose merges are in order of their ids."""
    model = json.loads(data)["model"]
    # Printable Latin-1 stands for itself, the other bytes for 256, 257, ... in order.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in order of their ids")
    made = set(made)
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if i in made or len(t) == 1}


def merge_bytes(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is a token."""
    if len(piece) > 64:
        return _merge_long(piece, rank)
    cut = list(range(len(piece) + 1))  # part i is piece[cut[i]:cut[i + 1]]
    get = rank.get
    pair = [get(piece[i:i + 2], NEVER) for i in range(len(piece) - 1)]
    while pair and (low := min(pair)) != NEVER:
        i = pair.index(low)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(piece[cut[i]:cut[i + 2]], NEVER)
        if i:
            pair[i - 1] = get(piece[cut[i - 1]:cut[i + 1]], NEVER)
    return tuple([rank[piece[i:j]] for i, j in zip(cut, cut[1:])])


def merge_table(rank: dict[bytes, int]) -> dict[int, int]:
    """Id of the token that two neighbouring tokens make, by (left id << 20) + right id."""
    table = {}
    for token, i in rank.items():
        for at in range(1, len(token)):
            left = rank.get(token[:at])
            if left is not None and (right := rank.get(token[at:])) is not None:
                table[(left << 20) + right] = i
    return table


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap of candidate pairs over a linked list."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:end[i]]; end[i] is the next part
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := rank.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := rank.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:end[i]]])
        i = end[i]
    return tuple(out)


class TreeCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.token = {i: b for b, i in rank.items()}
        self._merged = merge_table(rank)
        self._byte = [rank.get(bytes([b]), -1) for b in range(256)]
        #: Id of the token that two bytes make, by the first, then the second.
        self._two = [[rank.get(bytes([a, b]), NEVER) for b in range(256)] for a in range(256)]
        self._bytes, self._twos = np.array(self._byte, np.int64), np.array(self._two, np.int64)
        keys = sorted(self._merged)
        self._pairs = np.array([*keys, NEVER], np.int64)
        self._made = np.array([*map(self._merged.__getitem__, keys), NEVER], np.int64)
        self._seams: dict[tuple[int, ...], tuple[int, ...]] = {}

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if not piece:
            return ()
        own = self.rank.get(piece)
        if own is not None:
            return (own,)
        if len(piece) <= LEAF:
            return self._leaf(piece)
        mid = len(piece) // 2
        return self.join(self.encode(piece[:mid]), self.encode(piece[mid:]))

    def _leaf(self, piece: bytes) -> tuple[int, ...]:
        """``merge_bytes`` of a short half, over ids: a token's id is its rank."""
        get, two, byte = self._merged.get, self._two, self._byte
        ids = [byte[b] for b in piece]
        pair = [two[a][b] for a, b in zip(piece, piece[1:])]
        while pair and (low := min(pair)) != NEVER:
            i = pair.index(low)
            ids[i] = low
            del ids[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get((low << 20) + ids[i + 1], NEVER)
            if i:
                pair[i - 1] = get((ids[i - 1] << 20) + low, NEVER)
        return tuple(ids)

    def _leaves(self, pieces: list[bytes]) -> list[bytes]:
        """``_leaf`` of many halves at once, each of two bytes or more; little-endian 32-bit ids."""
        out: list[bytes] = [b""] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(length.max())
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < length[:, None], self._bytes[raw], -1)  # no pair has a part of -1
        pair = np.where(column[1:] < length[:, None], self._twos[raw[:, :-1], raw[:, 1:]], NEVER)
        who = np.arange(len(pieces))
        while True:
            at = pair.argmin(axis=1) if width > 1 else np.zeros(len(who), np.int64)
            low = pair[np.arange(len(who)), at] if width > 1 else np.full(len(who), NEVER)
            done = np.flatnonzero(low == NEVER)
            if len(done):
                packed, ends = ids[done].astype("<u4").tobytes(), (4 * (ids[done] >= 0).sum(axis=1)).tolist()
                for k, (i, n) in enumerate(zip(who[done].tolist(), ends)):
                    out[i] = packed[4 * width * k:4 * width * k + n]
                left = np.flatnonzero(low != NEVER)
                if not len(left):
                    return out
                who, at, low, ids, pair = who[left], at[left], low[left], ids[left], pair[left]
            # every row loses one part and one pair a round, so all stay of one width
            row = np.arange(len(who))
            ids[row, at] = low
            ids = ids[column[:width] != at[:, None] + 1].reshape(len(who), width - 1)
            pair = pair[column[:width - 1] != at[:, None]].reshape(len(who), width - 2)
            width -= 1
            for side in (0, 1):  # the pair the new part begins, and the one it ends
                there = np.flatnonzero(at < width - 1 if side == 0 else at > 0)
                first = at[there] - side
                x, y = ids[there, first], ids[there, first + 1]
                key = (x << 20) + y
                found = np.searchsorted(self._pairs, key)
                pair[there, first] = np.where((self._pairs[found] == key) & (y >= 0), self._made[found], NEVER)

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every piece; those that are leaves go together, the short and the long ones."""
        out: list[bytes] = [b""] * len(pieces)
        leaves: tuple[list[int], ...] = ([], [], [])
        together = min(self._byte) >= 0
        for i, piece in enumerate(pieces):
            n = len(piece)
            if together and 1 < n <= LEAF and piece not in self.rank:
                leaves[(n > LEAF // 3) + (n > LEAF // 2)].append(i)
            else:
                ids = self.encode(piece)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        for places in leaves:
            if places:
                for i, packed in zip(places, self._leaves([pieces[i] for i in places])):
                    out[i] = packed
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        seam = (left[-1], right[0])
        if self._again(seam) == seam:
            return left + right
        k = 1
        while True:
            x, y = left[-k:], right[:k]
            window = self._again(x + y)
            if (len(x) == len(left) or window[0] == x[0]) and (len(y) == len(right) or window[-1] == y[-1]):
                return left[:len(left) - len(x)] + window + right[len(y):]
            k *= 2

    def _again(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        found = self._seams.get(ids)
        if found is None:
            text = b"".join([self.token[i] for i in ids])
            found = self._leaf(text) if len(text) <= 2 * LEAF else merge_bytes(text, self.rank)
            if len(ids) <= 4:
                if len(self._seams) > REMEMBERED:
                    self._seams.clear()
                self._seams[ids] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4_096:
            return b"".join(map(self.token.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


#: The usual splitting pattern; for texts of ASCII and Latin letters alone, the same written with plain classes,
#: which is faster.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_NOT_PLAIN = re.compile(rf"[^ \t-\r!-~{_LATIN}]")


class Pieces:
    """Pieces of text and their ids as little-endian 32-bit numbers, remembered."""

    def __init__(self, pattern: str, ids_of, all_of=None):
        self.general = regex.compile(pattern).findall
        self.usual = pattern == USUAL
        self.ids_of = ids_of
        self.all_of = all_of
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self.usual and not _NOT_PLAIN.search(text):
            return _PLAIN_SPLIT.findall(text)
        return self.general(text)

    def encode(self, text: str) -> bytes:
        known = self.known
        if len(known) >= PIECES_REMEMBERED:
            known.clear()
        found = list(map(known.get, pieces := self.split(text)))
        if None in found:
            for i, packed in enumerate(found):
                if packed is None:
                    packed = known.get(piece := pieces[i])
                    if packed is None:
                        ids = self.ids_of(piece)
                        known[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
                    found[i] = packed
        return b"".join(found)


    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of every text; the new pieces of texts of together about ``CHUNK`` characters are encoded at once."""
        chunk: list[str] = []
        size = 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        if len(known) >= PIECES_REMEMBERED:
            known.clear()
        held, new = [], set()
        for text in texts:
            found = list(map(known.get, pieces := self.split(text)))
            gaps = []
            if None in found:
                gaps = [(i, pieces[i]) for i, packed in enumerate(found) if packed is None]
                new.update([piece for _, piece in gaps])
            held.append((found, gaps))
        new = list(new)
        known.update(zip(new, self.all_of([p.encode() for p in new])))
        for found, gaps in held:
            for i, piece in gaps:
                found[i] = known[piece]
            yield b"".join(found)


@lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> tuple[TreeCodec, Pieces]:
    """One codec per worker process and vocabulary."""
    tree = TreeCodec(parse_tokenizer(data) if data.lstrip()[:1] == b"{" else parse_ranks(data))
    return tree, Pieces(pattern, lambda piece: tree.encode(piece.encode()), tree.encode_all)


def vocabulary(spark, path: str):
    """The file of a vocabulary (under 2 MB) for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def as_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of whole texts."""
    data = vocabulary(docs.sparkSession, path)

    def make():
        pieces = codec(data.value, pattern)[1]

        def rows(batch):
            for doc, packed in zip(batch["doc_id"], pieces.encode_all(map(as_text, batch["text"]))):
                yield doc, np.frombuffer(packed, "<u4").astype(np.int32)
        return rows
    return map_rows(texts(docs), schema_of(docs, "doc_id", ids=T.ArrayType(T.IntegerType())), make)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of an encoded table; null ids give the empty text."""
    data = vocabulary(encoded.sparkSession, path)

    def make():
        tree = codec(data.value, pattern)[0]

        def rows(batch):
            for doc, ids in zip(batch["doc_id"], batch["ids"]):
                yield doc, tree.decode(ids or [])
        return rows
    out = map_rows(encoded.select("doc_id", "ids"), schema_of(encoded, "doc_id", text=T.BinaryType()), make)
    return out.withColumn("text", F.col("text").cast("string"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the bytes decoded from them, in one pass."""
    data = vocabulary(docs.sparkSession, path)

    def make():
        tree, pieces = codec(data.value, pattern)

        def rows(batch):
            for doc, packed in zip(batch["doc_id"], pieces.encode_all(map(as_text, batch["text"]))):
                decoded = tree.decode(np.frombuffer(packed, "<u4").tolist())
                yield (doc, len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                       hashlib.sha256(decoded).hexdigest())
        return rows
    return map_rows(texts(docs), schema_of(docs, "doc_id", n_tokens=T.LongType(), ids_sha256=T.StringType(),
                                           decoded_sha256=T.StringType()), make)


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens."""
    data = vocabulary(docs.sparkSession, path)

    def make():
        pieces = codec(data.value, pattern)[1]
        return lambda batch: ((doc, len(packed) // 4) for doc, packed in zip(
            batch["doc_id"], pieces.encode_all(map(as_text, batch["text"]))))
    return map_rows(texts(docs), schema_of(docs, "doc_id", n_tokens=T.LongType()), make)
