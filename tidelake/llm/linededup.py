"""Line dedup by winnowing over line hashes (operator 7), in DataFrame functions.

Of each ``run`` consecutive lines the one with the smallest hash (the rightmost of equals) is a fingerprint, so that
equal runs of that many lines hold an equal fingerprint at the same place. Each fingerprint is shuffled once, with the
hashes of the lines around it. Those whose hash stands at one place only are dropped; at the others, matches are extended
both ways to the runs that the fingerprint stands for, runs are compared by the hashes of all their lines, and every
line that lies in a run which is not the first of its kind is deleted. Longer repeats are chains of such runs. Where
``words`` is given, shorter runs of more than so many words count as well, so that every repeat of whole lines with more
than so many words is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, broadcast_if_small, cut, let

RUN = 3
#: A run of fewer lines has to have more words than this.
WORDS = 50


def _covered(around: Column, at: Column, run: int, words: int | None) -> Column:
    """The runs of lines that the fingerprint at ``at`` stands for: (at, size, lines) for those of which it is the least,
    of the lines (h, n: hash and words) ``around`` it."""
    placed = F.transform(around, lambda l, i: F.struct(l["h"].alias("h"), (-i).alias("back")))

    def of(size: int) -> Column:
        first = F.greatest(at - size + 1, F.lit(0))
        last = F.least(at, F.size(around) - size)
        own = lambda i: F.array_min(F.slice(placed, i + 1, size))["back"] == -at
        part = lambda i: F.slice(around, i + 1, size)
        long = (lambda i: F.lit(True)) if size == run else (lambda i: F.aggregate(part(i), F.lit(0), lambda n, l: n + l["n"]) > words)
        starts = F.filter(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda i: own(i) & long(i))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.transform(part(i), lambda l: l["h"]).alias("lines")))

    return F.concat(*[of(k) for k in ([run] if words is None else range(1, run + 1))])


def fingerprints(lines: Column, run: int, words: int | None) -> Column:
    """The winnowed lines of a text: their place, how many of the lines before are given, and the lines around them, up to
    ``run`` - 1 on either side."""

    def about(x: Column, p: Column) -> Column:
        before = F.least(p, F.lit(run - 1))
        return F.struct(p.alias("place"), before.alias("before"), F.slice(x, p - before + 1, before + run).alias("around"))

    def chosen(x: Column) -> Column:
        every = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda p: about(x, p)))
        return F.filter(every, lambda m: F.size(_covered(m["around"], m["before"], run, words)) > 0)

    return let(lines, chosen)


def line_dedup(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """Every row of ``docs`` with all its columns, ``text`` without the deleted lines, and n_lines, n_deleted added.

    Lines are split at \\n; those without a word are never counted, compared or deleted. Lines are equal if they are so
    after trimming and with white space as single spaces. A run is earlier by (doc_id, hash of the text, line), a null id
    first; the first stays whole unless it overlaps a later copy of its own. With ``words``, fewer than ``run`` lines are
    a run too if they have more words than that. A null or empty text has no lines and stays as it is; a very long one is
    taken whole. Rows that repeat a doc_id with another text are documents of their own; rows that repeat both are one
    document, and come out alike. Extra columns stay, but those named n_lines and n_deleted are replaced. An empty table
    stays empty. Lines and rows are told apart by 64-bit hashes: among n different lines, about n * n / 2**65 pairs are
    taken for equal, which matters only where the lines beside them are equal too.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rows = docs.select("doc_id", "text", F.struct(*[c for c in names if c != "text"]).alias("_all"), F.xxhash64("doc_id", "text").alias("_row"))
    full = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.transform(full, lambda x: F.trim(F.regexp_replace(x, f"{WHITE}+", " ")))
    count = (lambda x: F.size(F.split(x, " "))) if words is not None else lambda x: F.lit(0)
    lines = F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("h"), count(x).alias("n")))
    marks = rows.select("doc_id", F.col("_row").alias("row"), F.explode(fingerprints(lines, run, words)).alias("m"))
    marks = cut(marks.select("doc_id", "row", F.get("m.around", F.col("m.before"))["h"].alias("mark"), "m.place", "m.before", "m.around"))
    # A fingerprint at one place only can't be of a repeated run. Kept first, so that the join can split very common lines.
    place = F.struct("row", "place")
    again = cut(marks.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select(F.col("mark").alias("seen")))
    matched = marks.join(again, F.col("mark") == F.col("seen"))
    runs = matched.select("doc_id", "row", (F.col("place") - F.col("before")).alias("base"), F.explode(_covered(F.col("around"), F.col("before"), run, words)).alias("r"))
    runs = cut(runs.select(F.col("r.lines").alias("lines"), F.col("r.size").alias("size"), F.struct("doc_id", "row", (F.col("base") + F.col("r.at")).alias("at")).alias("place")))
    first = cut(runs.groupBy("lines").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("lines").alias("same"), "first"))
    later = runs.join(first, F.col("lines") == F.col("same")).where(F.col("place") != F.col("first"))
    gone = later.groupBy(F.col("place.row").alias("_of")).agg(F.collect_set(F.struct("place.at", "size")).alias("_at"))
    gone = cut(gone.select("_of", F.array_distinct(F.flatten(F.transform("_at", lambda a: F.sequence(a["at"], a["at"] + a["size"] - 1)))).alias("_gone")))
    out = rows.join(broadcast_if_small(gone, 50_000), F.col("_row") == F.col("_of"), "left")
    return _without(out, names)


def _without(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of _all; of text, lines whose numbers among the lines with a word are in _gone are deleted."""
    solid = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def kept(lines: Column) -> Column:
        where = F.filter(F.transform(lines, lambda x, i: F.when(solid(x), i)), lambda i: i.isNotNull())
        gone = let(where, lambda at: F.transform("_gone", lambda g: F.get(at, g)))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))

    lines = F.split("text", "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(let(lines, kept), "\n"))
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), solid)).cast("long")
    kept_columns = [text.alias("text") if c == "text" else F.col(f"_all.`{c}`").alias(c) for c in names]
    return rows.select(*kept_columns, n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_deleted"))
