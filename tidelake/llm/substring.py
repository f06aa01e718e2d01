"""Removal of recurring passages (operator 5).

1. Every window of 35 words is hashed; the hashes of a shard of documents go, packed and sorted, to the bucket of their
   leading bits, where those found twice are confirmed and sent back to the shards that hold them.
2. Each shard compiles an Aho-Corasick automaton from its confirmed passages: their words, taken at one place of each
   confirmed window and cut in blocks of 18, of which any window of 35 words inside a passage holds at least one.
3. Each shard streams its documents through its automaton, which alone finds the occurrences: a window around a block
   that is found counts if it has the passage's 35 words, and the words that such windows cover are removed.

Each document meets one automaton, and an automaton holds only passages that its own documents hold, so work and memory
grow with the input. A very common window is one hash per shard. Passages are confirmed across shards by 64-bit hashes:
among n windows of the corpus about n * n / 2**65 pairs of different windows are taken for equal (1e-3 at 2e8 windows,
under one at 6e9). Inside a shard words are compared, by their 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of
from .hashing import Hasher, chunks, rolling, texts_of, tokens

WINDOW = 35
#: Bytes of text of a shard, window hashes of a bucket, and hashes that a task holds before it passes them on.
SHARD_BYTES, BUCKET_HASHES, HELD = 8 << 20, 2 << 20, 8 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte of equal weight, which leaves runs of zeros to the shuffle's compression."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def window_hashes(texts: list[bytes], hasher: Hasher, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of texts: its first text, the number of words of each text, all word hashes, and the hashes of
    windows by the word that they start at (words where none starts are left out: see ``starts``)."""
    for i, j in chunks(texts):
        buf, starts, ends, first = tokens(texts[i:j])
        words = hasher.spans(buf, starts, ends)
        yield i, np.diff(first), words, rolling(words, window)


def starts(counts: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows over all words of a chunk lie inside one text."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of[: len(of) - window + 1] == of[window - 1 :] if len(of) >= window else np.zeros(0, bool)


def _counted(buckets: int, window: int):
    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = Hasher(), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                h, times = np.unique(np.concatenate(parts), return_counts=True)
                h = np.repeat(h, np.minimum(times, 2))  # twice if it is found twice here
                of = h >> shift
                cuts = np.flatnonzero(np.diff(of)) + 1
                parts = [p for p in np.split(h, cuts) if len(p)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([int(p[0] >> shift) for p in parts], pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array([pack(p) for p in parts], pa.binary())], ["bucket", "shard", "hashes"])
            held.clear()

        for batch in batches:
            texts, of = texts_of(batch.column(1)), batch.column(2).to_numpy()
            for shard in np.unique(of):
                for _, counts, _, h in window_hashes([texts[i] for i in np.flatnonzero(of == shard)], hasher, window):
                    held.setdefault(int(shard), []).append(h[starts(counts, window)])
                    n += len(h)
                    if n > HELD:
                        yield from out()
                        n = 0
        yield from out()

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: the hashes of a bucket that are found twice, for each shard that has them."""

    def out(rows: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, of = np.concatenate([x for _, x in rows]), np.repeat(np.array([s for s, _ in rows]), [len(x) for _, x in rows])
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        again = same[1:] | same[:-1]
        h, of = h[again], of[again]
        order = np.argsort(of, kind="stable")  # hashes stay sorted in each shard
        h, of = h[order], of[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        parts = [(s, np.unique(p)) for s, p in zip(of[np.r_[0, cuts]] if len(of) else [], np.split(h, cuts), strict=False)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([int(s) for s, _ in parts], pa.int32()), pa.array([pack(p) for _, p in parts], pa.binary())], ["shard", "hashes"])

    now, rows = None, []
    for batch in batches:
        for bucket, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != now and rows:
                yield from out(rows)
                rows = []
            now = bucket
            rows.append((shard, unpack(data.as_py())))
    if rows:
        yield from out(rows)


def spell(ids: np.ndarray) -> str:
    """Word numbers as characters; numbers over the greatest code point share characters, so what is found is compared word by word."""
    return (ids % 0x10FFFF + 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def first_places(known: np.ndarray, hashes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The confirmed hashes that the shard holds, sorted, and the first word of one window of each."""
    at = np.flatnonzero(valid)
    found, first = np.unique(hashes[at], return_index=True)
    held = np.isin(found, known, assume_unique=True)
    return found[held], at[first[held]]


def compiled(words: np.ndarray, places: np.ndarray, window: int):
    """The automaton of the passages that the windows at ``places`` make up, and each word's number in its alphabet (0:
    not in a passage). Its patterns are the blocks of (window + 1) // 2 words that a passage is cut into."""
    import ahocorasick

    block = (window + 1) // 2
    at = np.sort(places)
    runs = np.split(at, np.flatnonzero(np.diff(at) != 1) + 1)
    begins = np.concatenate([np.arange(r[0], r[-1] + window - block + 1, block) for r in runs])
    letters = np.unique(words[begins[:, None] + np.arange(block)])
    ids = np.searchsorted(letters, words)
    ids[ids == len(letters)] = 0
    ids = np.where(letters[ids] == words, ids + 1, 0)
    automaton = ahocorasick.Automaton()
    for s in {spell(ids[p : p + block]) for p in begins}:
        automaton.add_word(s, True)
    automaton.make_automaton()
    return automaton, ids


def occurrences(words: np.ndarray, counts: np.ndarray, known: np.ndarray, hashes: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """The first words of all windows of a shard that recur.

    Every text is streamed through the automaton of the shard's confirmed passages. A window around a block that it finds
    is an occurrence if its words are those of the passage's window; its hash only tells which window that is. What the
    automaton doesn't find is not looked at.

    words: the word hashes of all texts; counts: words of each text; known: confirmed hashes, sorted; hashes, valid: of the
    window at each word, and whether one lies there inside one text.
    """
    order, places = first_places(known, hashes, valid)
    if not len(places):
        return places
    automaton, ids = compiled(words, places, window)
    block = (window + 1) // 2
    near, base = np.zeros(len(words) + 1, np.int64), 0
    for n in counts:
        if n >= window:
            found = np.array([end for end, _ in automaton.iter(spell(ids[base : base + n]))], np.int64)
            if len(found):
                first = base + found - (block - 1)
                np.add.at(near, np.maximum(base, first - (window - block)), 1)
                np.add.at(near, first + 1, -1)
        base += n
    at = np.flatnonzero(valid & (np.cumsum(near[:-1]) > 0))
    passage = places[np.minimum(np.searchsorted(order, hashes[at]), len(order) - 1)]
    same = np.ones(len(at), bool)
    for k in range(window):
        same &= words[at + k] == words[passage + k]
    return at[same]


def _removed(window: int, keep: bool):
    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        texts = texts_of(docs.column("text").combine_chunks())
        known = np.unique(np.concatenate([unpack(x.as_py()) for x in confirmed.column("hashes")])) if len(confirmed) else np.zeros(0, np.uint64)
        hasher, counts, words, hashes, valid = Hasher(), [], [], [], []
        for _, n, w, h in window_hashes(texts, hasher, window):
            counts.append(n)
            words.append(w)
            full = np.zeros(len(w), np.uint64)
            full[: len(h)] = h
            ok = np.zeros(len(w), bool)
            ok[: len(h)] = starts(n, window)
            hashes.append(full)
            valid.append(ok)
        counts, words, hashes, valid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, words, hashes, valid))
        gone = np.zeros(len(words), bool)
        if len(known) and len(words):
            at = occurrences(words, counts, known, hashes, valid, window)
            cover = np.zeros(len(words) + 1, np.int64)
            cover[at] += 1
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
        rows, base = [], 0
        for doc_id, text, n in zip(docs.column("doc_id").to_pylist(), texts, counts.tolist(), strict=True):
            parts, lost = text.split(), gone[base : base + n]
            kept = b" ".join(compress(parts, ~lost) if lost.any() else parts)
            rows.append((doc_id, n, int(lost.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if keep else [])))
            base += n
        kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if keep else [])]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=[x for x, _ in kinds])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: bool = False, shard_bytes: int = SHARD_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, n_removed, kept_sha256 and,
    with ``keep``, the kept words joined by one space.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in another row or its own. All
    copies go, the first too. A null or empty text has no words; a text of fewer words than a window keeps them all.
    Rows that repeat a doc_id are rows of their own. A shard's texts (8 MB, one longer text, or a row's equals) are held by
    one task.
    """
    total = bytes_of(docs, "text")
    shards, buckets = max(1, -(-total // shard_bytes)), max(1, -(-total // (6 * bucket_hashes)))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    placed = rows.repartition(shards, "shard")
    # Both uses of ``placed`` have the same columns and nothing that isn't deterministic, so that Spark shuffles texts once.
    counted = placed.mapInArrow(_counted(buckets, window), "bucket int, shard int, hashes binary")
    confirmed = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_confirmed, "shard int, hashes binary")
    return placed.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(_removed(window, keep), RESULT + (", kept string" if keep else ""))
