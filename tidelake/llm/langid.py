"""Language identification by rank-order profiles (operator 3).

A text's n-grams of one to three characters, of lower-case words with a space at either end, are ranked by frequency.
Its distance to a language is the sum over its most frequent n-grams of how far each is out of place in the language's
profile; an n-gram that the profile lacks costs the profile's length. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a language's profile, and how many n-grams of a text are compared with it.
PROFILE, COMPARED = 400, 300
#: n-grams that a training task holds before it sums them up, and summed ones before it passes them on.
HELD = 2_000_000
UNKNOWN = "und"
#: Stands for what separates words in n-grams; no letter has this number.
GAP = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The n-grams of the whole text as numbers, 21 bits a character; as often as they are there."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one gap after each word
    a = np.concatenate([[GAP], np.where(letter, points, GAP)[kept], [GAP]])
    if not letter[-1]:
        a = a[:-1]
    two = a[:-1] << 21 | a[1:]
    three = (two[:-1] << 21 | a[2:])[a[1:-1] != GAP]
    return np.concatenate([a[a != GAP], two, three])


def ranked(text: str, most: int) -> np.ndarray:
    """The text's most frequent n-grams by falling count, equal counts by their numbers."""
    found, times = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-times, kind="stable")[:most]]


Profiles = dict[str, tuple[np.ndarray, np.ndarray]]


def learn(docs: DataFrame, profile: int = PROFILE) -> Profiles:
    """{language: (sorted n-grams, the rank of each)} from all rows with text and lang. Counts are summed in each task
    before the shuffle; only the profiles (languages x ``profile`` n-grams) come to the driver. Languages without a letter
    get no profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        summed: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        n = 0

        def add_up() -> None:
            for lang, parts in held.items():
                found, times = np.unique(np.concatenate(parts), return_counts=True)
                if lang in summed:
                    both = np.concatenate([summed[lang][0], found])
                    found, at = np.unique(both, return_inverse=True)
                    times = np.bincount(at, np.concatenate([summed[lang][1], times])).astype(np.int64)
                summed[lang] = found, times
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            add_up()
            for lang, (found, times) in summed.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["lang", "gram", "n"])
            summed.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = grams(text.as_py())
                held.setdefault(lang, []).append(found)
                n += len(found)
                if n > HELD:
                    add_up()
                    n = 0
                    if sum(len(f) for f, _ in summed.values()) > HELD:
                        yield from out()
        yield from out()

    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= profile)
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, rank in best.select("lang", "gram", "rank").collect():
        found.setdefault(lang, []).append((gram, rank - 1))
    return {lang: tuple(np.array(sorted(rows), np.int64).T) for lang, rows in sorted(found.items())}


def nearest(text: str, profiles: Profiles, compared: int = COMPARED, profile: int = PROFILE) -> tuple[str, float]:
    """(language, score). The score is one less the distance over the greatest possible one: 0 if the text shares no
    n-gram with the profile. Equal distances go to the first name; without letters or profiles it is (und, 0)."""
    own = ranked(text, compared)
    if not len(own) or not profiles:
        return UNKNOWN, 0.0
    best, least, place = UNKNOWN, None, np.arange(len(own))
    for lang, (known, ranks) in profiles.items():
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        far = int(np.where(known[at] == own, np.abs(ranks[at] - place), profile).sum())
        if least is None or far < least:
            best, least = lang, far
    return best, max(0.0, 1.0 - least / (profile * len(own)))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Every row of ``docs`` with all its columns, and lang_pred and score added (columns of these names are replaced).

    Only the text is looked at, all of it, however long. A null or empty text, or one without a letter, is ``und`` with
    score 0. Repeated rows are rows of their own. Only texts go to Python, and only the two results come back.
    """

    @F.arrow_udf("struct<lang_pred string, score double>")
    def verdict(texts: pa.Array) -> pa.Array:
        found = [nearest(x.as_py() or "", profiles) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    name = "_verdict"
    while name in docs.columns:
        name += "_"
    out = docs.drop("lang_pred", "score").withColumn(name, verdict("text"))
    return out.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row (doc_id, text, lang; other columns are ignored); profiles are learned
    from the rows that aren't held out and have text and lang. Without any, all rows are ``und``."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
