"""Quality rules by cross-document line frequency (operator 4), in DataFrame functions only.

Base rules judge each text by itself. Then lines are normalised and hashed, the distinct documents of each host that
hold a line are counted, lines above the limits are taken out, and a document that loses too much is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, broadcast_if_small, cut, let, words

#: Fixed values of the base rules.
SYMBOLS, WHITE_CHARS, WINDOW, LEAST_WORDS, REPEAT_PERCENT = "#*$%&|<>", " \t\n\x0b\x0c\r", 8, 20, 30


@dataclass(frozen=True)
class LineLimits:
    """A line is common when at least ``docs`` documents of its host hold it and these are at least ``share`` of the
    host's documents. A document is depleted when common lines hold over ``depleted`` of its word characters."""

    docs: int = 10
    share: float = 0.005
    depleted: float = 0.5
    broadcast_rows: int = 100_000


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of eight words that are found twice or more in ``w``.

    The hashes of all windows are sorted with their places, equal neighbours are kept, and the covered words are
    summed over the places in order: O(n log n) for a text, however often its windows repeat.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i)["h"] == x["h"])  # noqa: E731  out of range: null
        again = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
        return F.when(F.size(again) == 0, F.lit(0)).otherwise(let(F.sort_array(again["at"]), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, WINDOW)).alias("h"), i.alias("at")))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(F.sort_array(windows), places))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"{WHITE}+", " "))


def base_metrics(docs: DataFrame, key: Column) -> DataFrame:
    """key, doc_id, source, the base figures of each row, and its normalised lines as (h, chars)."""
    text = F.coalesce("text", F.lit(""))
    solid = F.translate(text, WHITE_CHARS, "")
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        keyed = F.transform(lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.length(F.translate(x, WHITE_CHARS, "")).alias("chars")))
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), keyed.alias("lines"))

    out = docs.select(
        key.alias("key"), "doc_id", "source",
        let(words(F.col("text")), of_words).alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(full, of_lines).alias("l"),
    )
    failed = (F.col("w.n_words") < LEAST_WORDS) | (100 * F.col("w.n_repeat_words") > REPEAT_PERCENT * F.col("w.n_words"))
    return out.select("key", "doc_id", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "l.lines")


def common_lines(rows: DataFrame, limits: LineLimits) -> DataFrame:
    """(source, h) of lines above the limits, by the distinct documents of a host. Counts are pre-aggregated in each task, so
    a hot host or line is a row a task; only rows that repeat the id of another are made distinct first."""
    repeated = cut(rows.where("doc_id IS NOT NULL").groupBy("source", "doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    again = repeated.select(F.col("source").alias("s"), F.col("doc_id").alias("d"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("doc_id") == F.col("d"))
    hosts = rows.select("source", F.lit(1).alias("n")).unionByName(repeated.select("source", (1 - F.col("n")).alias("n"))).groupBy("source").agg(F.sum("n").alias("host_docs"))
    each = lambda x: x.select("source", "doc_id", F.explode(F.array_distinct("lines.h")).alias("h"))
    lines = each(rows.join(again, same, "left_anti")).unionByName(each(rows.join(again, same, "left_semi")).distinct())
    found = lines.groupBy("source", "h").agg(F.count("*").alias("line_docs"))
    found = found.where(F.col("line_docs") >= limits.docs).join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
    return found.where(F.col("line_docs") >= limits.share * F.col("host_docs")).select("source", "h")


def quality(docs: DataFrame, limits: LineLimits = LineLimits(), texts: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored, whatever their names).

    A null or blank text has no words and fails the base rules; a very long one is judged whole. A null source is a host of
    its own, and a row without an id a document of its own. Rows that repeat an id are judged each by its own text, but
    count as one document of their host. Limits that are just reached count as reached. An empty table gives an empty result.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars and, with
    ``texts``, the text without its common lines.
    """
    key = F.xxhash64("doc_id", "source", "text")
    base = cut(base_metrics(docs, key).withColumn("row", F.monotonically_increasing_id()))  # kept, so that numbers stay
    common = broadcast_if_small(cut(common_lines(base, limits)).withColumnsRenamed({"source": "host", "h": "line"}), limits.broadcast_rows)
    held = base.where(F.size("lines") > 0).select("row", "key", "source", F.explode("lines").alias("x")).select("row", "key", "source", "x.h", "x.chars")
    held = held.join(common, F.col("source").eqNullSafe(F.col("host")) & (F.col("h") == F.col("line")))
    lost = held.groupBy("row").agg(F.sum("chars").alias("removed_chars"))
    out = base.drop("lines").join(lost, "row", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("removed_chars") <= limits.depleted * F.col("word_chars"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars"]
    out = out.withColumn("kept", kept)
    if not texts:
        return out.select(*names)
    gone = cut(held.groupBy(F.col("key").alias("of")).agg(F.collect_set("h").alias("gone")))  # equal rows lose the same lines
    full = docs.select("text", key.alias("of")).groupBy("of").agg(F.first("text").alias("text")).join(gone, "of", "left")
    stays = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("gone", F.xxhash64(normal_line(x)))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    return out.join(full.select("of", text.alias("text")), F.col("key") == F.col("of")).select(*names, "text")
