"""MinHash near-dedup (operator 1): SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash (Ertl 2017) gives each element a random rank permutation: in step j an element offers j plus a random
fraction to the j-th slot of its permutation, so the slots of one element are spread evenly and signatures vary less
than independent hashes. Steps go on only until every slot of a document is filled; here all elements of many documents
take a step at once.

Documents with equal sets are one class from then on. Classes that share a band are a bucket, and each bucket has a pivot.

1. Every class is compared with the pivots of its buckets, on full sets. That links most copies, and leaves for each class
   its delta: the shingles that only it or only the pivot has. Sizes and deltas tell exactly how alike two classes with one
   pivot are.
2. Such a pair, if not both are linked with the pivot, only reaches the threshold if its deltas share so many shingles that
   the first ones of both, up to a length that follows from the sizes, have one in common (prefix filter). Deltas are
   ordered by how many of the group have a shingle, rarest first, so that classes that aren't alike seldom meet.
3. In each such shingle, all classes are compared with one of them; then those that meet and still have different labels.

Nothing is ruled out by an estimate: the only pairs at the threshold that are lost are those that share no band, with a
probability of 2e-8. A group of texts that are alike, but not enough so, costs little more than its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, packed
from .graph import components
from .hashing import Hasher, U, chunks, mix, rolling, texts_of, tokens

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 24, 4
#: Bytes of text whose signatures are made at once.
CHUNK = 1 << 19
#: Partners of one class that a task verifies.
PARTNERS = 64
NODE = "doc_id long, n long, set_a long, set_b long, bands array<long>"
#: n and m: the shingles of u and v; ``of`` tells u's texts apart where several rows have its doc_id. v's delta to u: what v
#: has and u lacks, then what u has and v lacks, by hash each.
COMPARED = "u long, v long, of long, linked boolean, n long, m long, delta array<long>"
#: Rows that a task takes of frames that hold signatures or deltas, and of those of a few numbers.
CLASSES, PAIRS = 10_000, 100_000
#: Shingles of deltas that a batch holds.
HELD = 1 << 20


def shingle_sets(texts: list[bytes], hasher: Hasher) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; of fewer words than a shingle has, one for the sequence."""
    for i, j in chunks(texts):
        buf, starts, ends, first = tokens(texts[i:j])
        h = hasher.spans(buf, starts, ends)
        rolled = rolling(h, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(rolled[a : b - SHINGLE + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            else:
                yield mix(rolling(h[a:b], b - a) + U(b - a)) if b > a else np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set: a row of slots, each a step (high 32 bits) and a fraction (low 32 bits)."""
    unset = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), slots), unset)
    flat = out.reshape(-1)
    e = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = None
    for j in range(slots):
        if not len(e):
            break
        with np.errstate(over="ignore"):
            x = mix(e + U(j + 1) * U(0x9E3779B97F4A7C15))
        k = j + ((x & U(0xFFFFFFFF)) * U(slots - j) >> U(32)).astype(np.int64)
        if places is None:
            slot = k
        else:
            at = np.arange(len(e))
            slot = places[at, k]
            places[at, k] = places[at, j]
            places[at, j] = slot
            slot = slot.astype(np.int64)
        np.minimum.at(flat, of * slots + slot, (U(j) << U(32)) | (x >> U(32)))
        open_ = (out == unset).any(axis=1)[of]
        if not open_.all():
            e, of, k = e[open_], of[open_], k[open_]
            places = places[open_] if places is not None else None
        if places is None and len(e):
            places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(e), 1))
            at = np.arange(len(e))
            places[at, k] = 0
            places[:, 0] = k
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = mix(np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1)))
    for r in range(rows):
        h = mix(h ^ sig[:, r : bands * rows : rows])
    return h


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(fold=True)
    names = [x.split()[0] for x in NODE.split(", ")]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
    for batch in batches:
        texts = texts_of(batch.column(1))
        for i, j in chunks(texts, CHUNK):
            sets = list(shingle_sets(texts[i:j], hasher))
            sig = signatures(sets)
            sums = [np.array([mix(s ^ U(c)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for c in (0x51ED, 0xC0FFEE)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), lists(band_hashes(sig))], names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, side, id, text), the texts of ``a`` (side 0) before those of its partners."""
    hasher, now, own, held = Hasher(fold=True), None, [], 0
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        *plain, delta = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, delta)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate(delta))
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds, strict=True)), lists], [x.split()[0] for x in COMPARED.split(", ")])

    for batch in batches:
        a, salt, side, ids = (batch.column(i).to_pylist() for i in range(4))
        for i, s in enumerate(shingle_sets(texts_of(batch.column(4)), hasher)):
            if (a[i], salt[i]) != now:
                now, own = (a[i], salt[i]), []
            if side[i] == 0:
                own.append((int(mix(s).sum().view(np.int64)), s))
                continue
            for of, o in own:
                delta = np.concatenate([np.setdiff1d(s, o, assume_unique=True), np.setdiff1d(o, s, assume_unique=True)])
                apart, total = len(delta), len(s) + len(o)  # of both: (total - apart) / 2, of either: (total + apart) / 2
                rows.append((a[i], ids[i], of, 100 * (total - apart) >= PERCENT * (total + apart), len(o), len(s), delta.view(np.int64)))
                held += apart
                if held > HELD:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()
            rows, held = [], 0


def compare(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """COMPARED for the pairs (a, b) of doc_ids. Each text goes once to each group of at most about PARTNERS pairs of one
    ``a``; one with more partners is dealt to several groups. Of rows that repeat a doc_id, every text is compared."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS).select(F.col("a").alias("hub"), F.ceil(F.col("n") / PARTNERS).cast("int").alias("groups"))
    dealt = pairs.join(broadcast_if_small(cut(many), 200_000), F.col("a") == F.col("hub"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).cast("int").alias("salt"))
    dealt = packed(dealt, PAIRS)
    uses = dealt.select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("id")).distinct().unionByName(dealt.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("id")))
    uses = broadcast_if_small(cut(uses), 200_000)
    texts = docs.select("doc_id", "text").join(uses, F.col("doc_id") == F.col("id")).select("a", "salt", "side", "id", "text")
    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(_compared, COMPARED)


def least_shared(d: Column, e: Column, n: Column, m: Column) -> Column:
    """How many shingles the deltas of two classes (d and e long; of n and m shingles) share at least, if the classes reach
    the threshold. With both sets' sizes and H = d + e - 2 * shared: 100 * (n + m - H) >= PERCENT * (n + m + H)."""
    return F.ceil(((100 + PERCENT) * (d + e) - (100 - PERCENT) * (n + m)) / (2.0 * (100 + PERCENT)) - 1e-9).cast("int")


def mixed_groups(compared: DataFrame, label: DataFrame) -> DataFrame:
    """The compared classes of pivots whose classes have different labels, each with a number ``g`` for class and pivot."""
    own = compared.join(label, F.col("v") == F.col("node"), "left").withColumn("label", F.coalesce("component", "v"))
    mixed = own.groupBy("u").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p != q").select(F.col("u").alias("pivot"))
    own = own.join(mixed, F.col("u") == F.col("pivot"))
    return own.select(F.xxhash64("u", "of", "v").alias("g"), "u", "of", "v", "linked", "n", "m", F.size("delta").alias("d"), "delta")


def places(own: DataFrame) -> DataFrame:
    """(key, g, v, m, d, at): the shingles by which classes of ``mixed_groups`` may meet, with their places in the deltas.

    Only shingles that two deltas of a group have are shuffled back; the others come first in each delta, being rarer. A
    class that is linked with the pivot has to meet one that isn't, whose delta is over (100 - PERCENT) / (100 + PERCENT)
    of its and the pivot's shingles, so the two share over half of the linked one's delta, less what it is longer than the
    pivot. One that isn't may also meet a linked one, whose delta has a shingle at least.
    """
    each = own.select("g", "u", "of", F.explode("delta").alias("shingle")).select("g", F.xxhash64("u", "of", "shingle").alias("key"))
    often = packed(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("again"), "n"), PAIRS)
    shared = each.join(often, F.col("key") == F.col("again")).groupBy(F.col("g").alias("of_g")).agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    rate, slack = (100 - PERCENT) / (100 + PERCENT), 1e-9
    apart = F.floor((F.col("d") + rate * (F.col("n") - F.col("m"))) / 2 - slack) + 1  # with one that isn't linked
    beside = F.ceil((F.col("d") + (1 - rate) - rate * (F.col("n") + F.col("m"))) / 2 - slack)  # one that isn't, with one that is
    least = F.greatest(F.when(F.col("linked"), apart).otherwise(F.least(apart, beside)), F.lit(1)).cast("int")
    rows = own.drop("delta").withColumn("first", F.col("d") - least + 1).join(shared, F.col("g") == F.col("of_g"))
    alone = F.col("d") - F.size("keys")
    found = rows.select("g", "v", "m", "d", alone.alias("alone"), F.posexplode(F.slice("keys", F.lit(1), F.greatest(F.col("first") - alone, F.lit(0)))).alias("i", "k"))
    return packed(found.select("k.key", "g", "v", "m", "d", (F.col("alone") + F.col("i")).alias("at")), PAIRS)


def _may_link(l: str, r: str) -> Column:
    """Whether two places of one key can belong to classes at the threshold."""
    of = lambda side, name: F.col(f"{side}.{name}")
    need = least_shared(of(l, "d"), of(r, "d"), of(l, "m"), of(r, "m"))
    return (100 * F.least(of(l, "m"), of(r, "m")) >= PERCENT * F.greatest(of(l, "m"), of(r, "m"))) & (of(l, "at") <= of(l, "d") - need) & (of(r, "at") <= of(r, "d") - need)


def linked(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (g, h) of classes with one pivot that reach the threshold, as (u, v); by their deltas, which is exact."""
    l = own.select(F.col("g").alias("a"), F.col("v").alias("x"), F.col("m").alias("n"), F.col("delta").alias("own"))  # noqa: E741
    r = own.select(F.col("g").alias("b"), F.col("v").alias("y"), F.col("m").alias("m"), F.col("delta").alias("other"))
    apart, total = F.size("own") + F.size("other") - 2 * F.size(F.array_intersect("own", "other")), F.col("n") + F.col("m")
    both = pairs.join(l, F.col("g") == F.col("a")).join(r, F.col("h") == F.col("b"))
    return both.where(100 * (total - apart) >= PERCENT * (total + apart)).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def links_within(own: DataFrame, links: DataFrame) -> DataFrame:
    """Further links between classes with one pivot: as many as it takes to connect all that are."""
    at = places(own)
    one = at.groupBy("key").agg(F.min(F.struct(F.xxhash64("v").alias("x"), "g", "v", "m", "d", "at")).alias("p")).select(F.col("key").alias("same"), "p.*")
    star = at.alias("l").join(one.alias("p"), (F.col("l.key") == F.col("p.same")) & (F.col("l.v") != F.col("p.v")) & _may_link("l", "p"))
    star = packed(star.select(F.col("l.g").alias("g"), F.col("p.g").alias("h")).distinct(), PAIRS)
    links = packed(links.unionByName(linked(star, own)), PAIRS)
    label = cut(components(links, 1))  # nodes of one label are linked, which is enough here
    named = at.join(label, F.col("v") == F.col("node"), "left").select("key", "g", "v", "m", "d", "at", F.coalesce("component", "v").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p != q").select(F.col("key").alias("same"))
    named = packed(named.join(mixed, F.col("key") == F.col("same")).drop("same"), PAIRS)
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.v") < F.col("r.v")) & (F.col("l.label") != F.col("r.label")) & _may_link("l", "r")
    rest = named.alias("l").join(named.alias("r"), on).select(F.col("l.g").alias("g"), F.col("r.g").alias("h")).distinct()
    return links.unionByName(linked(packed(rest, PAIRS), own))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored, whatever their names): doc_id, n_shingles,
    component_id, kept.

    A text without words, or null, has an empty set and is linked with nothing. Very long texts are taken whole, each by
    one task. Rows that repeat a doc_id are one document to links: they share a component. A row without a doc_id is linked
    with nothing, has no component, and is kept. Ties between pivots go by hash and id. An empty table gives an empty result.
    """
    nodes = cut(docs.select("doc_id", "text").mapInArrow(_nodes, NODE))
    classes = nodes.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "set_a", "set_b").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    classes = packed(classes.select("n", "set_a", "set_b", F.col("x.doc_id").alias("rep"), "x.bands"), CLASSES)

    banded = classes.select("rep", F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("rep").alias("h"), "rep")  # one class is the pivot of most of its buckets
    shared = banded.groupBy("band").agg(F.count("*").alias("size"), F.min(order).alias("p")).where("size > 1").select(F.col("band").alias("bucket"), F.col("p.rep").alias("pivot"))
    pairs = banded.join(shared, F.col("band") == F.col("bucket")).where(F.col("rep") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    compared = packed(compare(packed(pairs, PAIRS), docs), CLASSES)
    links = compared.where("linked").select("u", "v")
    own = packed(mixed_groups(compared, components(links, 1)), CLASSES)
    if not own.isEmpty():
        links = links_within(own, links)

    found = components(links)
    named = classes.select("n", "set_a", "set_b", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("m"), F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.coalesce("component", "rep").alias("component"))
    on = (F.col("n") == F.col("m")) & (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & F.col("doc_id").isNotNull()
    out = nodes.join(named, on, "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))
