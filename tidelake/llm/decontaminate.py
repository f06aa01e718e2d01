"""Benchmark decontamination by winnowing (operator 9), in DataFrame functions only.

Of every W consecutive K-gram hashes the smallest (the rightmost of equals) is a fingerprint, so two texts that share
K + W - 1 words share a fingerprint at the same place of the shared span. Training fingerprints are joined with those
of the benchmark; at each hit, the windows of ten words that hold it are compared word by word with the benchmark's
windows. An item of fewer words is one window, found by the hash of all its words. Only hashes and places are joined
with the benchmark, all in one pass over the documents; texts are read again only where there was a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, let, lower_ascii

#: The separators of words, the window and the fingerprints (K + W - 1 = WINDOW).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW, K, W = 10, 5, 6
#: Low bits of a long that hold a place in a text.
PLACES = (1 << 28) - 1
#: Rows of a side that are broadcast (under 100 MB); a larger one is shuffled.
BROADCAST = 200_000


def item_words(text: Column) -> Column:
    """Split before lower-casing, which is cheap for words of ASCII letters; only other words are translated by letter."""
    low = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(lower_ascii(w))
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SEPARATORS}+"), ""), low)


def grams(w: Column, n: int) -> Column:
    """(at, words joined by spaces) of each n consecutive words; words hold no space."""
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) < n, F.array().cast("array<struct<at:int,words:string>>")).otherwise(F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("words"))))


def fingerprints(w: Column) -> Column:
    """Places of the winnowed K-grams of texts with WINDOW words or more; else none.

    A gram's hash and its place, counted down, share one long, so that the least of a window is its smallest hash and,
    of equal ones, the rightmost; which gram is chosen depends on the window's words alone.
    """
    keyed = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(F.slice(w, i + 1, K)).bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i))
    least = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - W + 1), lambda i: F.array_min(F.slice(h, i, W))))
    places = F.transform(let(keyed, least), lambda x: (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("int"))
    return F.when(F.size(w) < WINDOW, F.array().cast("array<int>")).otherwise(places)


def marks(w: Column, lengths: list[int]) -> Column:
    """(h, at, n): the fingerprints of a text, n being 0, and each of its grams of the ``lengths`` of short items."""
    gram = lambda at, n: F.struct(F.xxhash64(F.lit(n), F.slice(w, at + 1, n or K)).alias("h"), at.alias("at"), F.lit(n).alias("n"))
    none = F.array().cast("array<struct<h:bigint,at:int,n:int>>")

    def of(n: int) -> Column:
        return F.when(F.size(w) < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda at: gram(at, n)))

    return F.concat(F.transform(fingerprints(w), lambda at: gram(at, 0)), *[of(n) for n in lengths])


def windows_at(w: Column, places: Column) -> Column:
    """(at, words) of the windows of ``w`` that each of the places (at, n) stands for, each window once."""

    def around(p: Column) -> Column:
        lo = F.greatest(F.lit(0), p["at"] - (WINDOW - K))
        near = grams(F.slice(w, lo + 1, F.least(p["at"] + WINDOW, F.size(w)) - lo), WINDOW)
        short = F.array(F.struct(p["at"].alias("at"), F.array_join(F.slice(w, p["at"] + 1, p["n"]), " ").alias("words")))
        return F.when(p["n"] > 0, short).otherwise(F.transform(near, lambda g: F.struct((g["at"] + lo).alias("at"), g["words"].alias("words"))))

    return F.array_distinct(F.flatten(F.transform(places, around)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored, whatever their names): doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated, and hit_at (array of the first words of matched windows with their lengths).

    A null or empty text has no words and no hits; a very long one is taken whole. Items without words match nothing; an
    item with a null id counts as a hit but not as an item; items that repeat an id are one item with the windows of all;
    items with equal windows are all found. Rows that repeat a doc_id are judged each by its own text, and come out as often
    as they are there. Empty tables on either side are fine.
    """
    items = cut(benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0))
    own = F.when(F.size("w") < WINDOW, F.array(F.struct(F.lit(0).alias("at"), F.array_join("w", " ").alias("words")))).otherwise(grams(F.col("w"), WINDOW))
    windows = items.select("item_id", F.explode(own).alias("g")).groupBy("g.words").agg(F.collect_set("item_id").alias("items"))
    windows = cut(windows.select(F.col("words").alias("window"), "items"))
    lengths = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # nine at most
    short = [F.when(F.size("w") == n, F.array(F.xxhash64(F.lit(n), F.slice("w", 1, n)))).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    known = items.select(F.explode(F.concat(let(F.col("w"), lambda w: F.transform(marks(w, []), lambda m: m["h"])), *short)).alias("mark")).distinct()
    known = broadcast_if_small(cut(known), broadcast)

    key = F.xxhash64("text")
    words = docs.select("doc_id", key.alias("row"), item_words(F.col("text")).alias("w"))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("at"), F.lit(0).alias("n"))
    each = words.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(none), let(F.col("w"), lambda w: marks(w, lengths)))).alias("m"))
    hits = each.select("doc_id", "row", "n_words", "m.h", "m.at", "m.n").join(known, F.col("h") == F.col("mark"), "left").where((F.col("at") < 0) | F.col("mark").isNotNull())
    place = F.when(F.col("at") >= 0, F.struct("at", "n"))
    rows = cut(hits.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("at") < 0).alias("copies"), F.collect_set(place).alias("places")))

    # Equal texts have equal hits, so each is looked at once.
    texts = rows.where(F.size("places") > 0).select(F.col("row").alias("of"), "places").dropDuplicates(["of"])
    texts = words.select("row", "w").join(broadcast_if_small(cut(texts), broadcast // 10), F.col("row") == F.col("of")).select("row", F.explode(let(F.struct("w", "places"), lambda x: windows_at(x["w"], x["places"]))).alias("g"))
    found = texts.select("row", "g.at", "g.words").join(broadcast_if_small(windows, broadcast), F.col("words") == F.col("window"))
    size = F.size(F.split("words", " "))  # words hold no space
    found = found.groupBy(F.col("row").alias("of")).agg(F.collect_set(F.struct("at", size.alias("len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(s["at"], a["to"]))).alias("n"), F.greatest(a["to"], s["at"] + s["len"]).alias("to"))
    covered = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), add, lambda a: a["n"].cast("long"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    found = found.select("of", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("ids"), "spans")
    one = rows.join(found, F.col("row") == F.col("of"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return one.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>")).alias("hit_at"))
