"""Byte-level BPE encoding and decoding (operator 8).

Tokens are found by an Aho-Corasick automaton (pyahocorasick works on text, so bytes are mapped to Latin-1 characters).
Encoding walks a piece from the left, takes the longest token at each place and goes back to the next shorter one when
the token can't stand next to its predecessor in any result of the merges. Whether two tokens can be neighbours is
memoised; a bit for each place stops dead ends from being tried again, so a piece of n bytes takes O(n) steps and
gives exactly what merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces whose ids a worker remembers at most; then it starts anew.
REMEMBERED = 200_000
#: A longer piece isn't remembered.
LONG_PIECE = 32
#: Tokens that a batch of results holds.
HELD = 1 << 20


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.split_of = self._splits()
        #: Tokens that merging can give; a whole piece may be another one.
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.split_of}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits = lru_cache(1 << 17)(self._fits)
        self.shorter = lru_cache(1 << 16)(self._shorter)
        self.known: dict[str, bytes] = {}

    def _splits(self) -> dict[int, tuple[int, int]]:
        """The pair of tokens whose merge makes each token; a single byte has none. A token that merging its own bytes
        can't give has none either and never results."""
        out = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    out[rank] = (parts[0], parts[1])
        return out

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging with ranks under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours: undo the latest merge at their border again and again; there must be no
        pair whose own merge would have come before. Of merges of one rank, the one further left comes first."""
        limit = len(self.bytes_of) + 1
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if merged is not None and merged < limit:
                return False
            a, b = self.split_of.get(left), self.split_of.get(right)
            if a and (left > right or not b):
                limit, left = left, a[1]
            elif b:
                limit, right = right + 1, b[0]
            else:
                return True

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        data = self.bytes_of[token]
        return next((self.usable[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.usable), -1)

    def longest(self, data: bytes) -> list[int]:
        """For each place the longest token that starts there, by one pass of the automaton."""
        out, size = [-1] * len(data), [0] * len(data)
        for end, (n, rank) in self.automaton.iter(data.decode("latin-1")):
            at = end - n + 1
            if n > size[at]:
                size[at], out[at] = n, rank
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        longest, fits, bytes_of = self.longest(data), self.fits, self.bytes_of
        dead = bytearray(len(data) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(bytes_of[token])
            if not dead[end] and (not ids or fits(ids[-1], token)):
                ids.append(token)
                at = end
                if at == len(data):
                    return ids
                token = longest[at]
                continue
            shorter = self.shorter(token)
            while shorter < 0:  # no token is left here: go back, and never come here again
                dead[at] = 1
                token = ids.pop()
                at -= len(bytes_of[token])
                shorter = self.shorter(token)
            token = shorter

    def encode(self, text: str) -> array:
        known, parts, out = self.known, [], array("I")
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
                if len(piece) <= LONG_PIECE:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            parts.append(ids)
        out.frombytes(b"".join(parts))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def _codec(data: bytes, pattern: str) -> Bpe:
    return Bpe(load_ranks(data), pattern)


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep``, also ids (array<int>)
    and decoded (the text after the round trip).

    A null or empty text has no tokens and the digests of nothing. Repeated rows give repeated results; other columns are
    ignored, whatever their names. A text is encoded whole, however long; its ids take four bytes each. ``ranks`` is
    the content of a rank file, read by the driver (under 1 MB) and sent with the function, so workers open no files.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = RESULT + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        codec = _codec(broadcast.value, pattern)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            digests, ends, flat, texts, at = [], [0], array("I"), [], 0

            def out(upto: int) -> pa.RecordBatch:
                counts = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
                columns = [batch.column(0).slice(at, upto - at), counts, *(pa.array(c, pa.string()) for c in zip(*digests, strict=True))]
                if keep:
                    ids = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat.tobytes())])
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(texts, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names)

            for i, text in enumerate(batch.column(1)):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                little = ids
                if sys.byteorder == "big":
                    little = array("I", ids)
                    little.byteswap()
                digests.append((hashlib.sha256(little.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                ends.append(ends[-1] + len(ids))
                if keep:
                    flat += ids
                    texts.append(decoded.decode("utf-8", "replace"))
                if keep and ends[-1] > HELD or i + 1 == len(batch):
                    yield out(i + 1)
                    digests, ends, flat, texts, at = [], [0], array("I"), [], i + 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)
