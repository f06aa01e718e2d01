"""Each operator against a plain version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from tidelake.llm import bpe, decontaminate, graph, hashing, langid, licenses, linededup, minhash, quality, sharding, substring, warc
from tidelake.llm.common import scratch

from . import brute

rnd = random.Random(5)
VOCABULARY = ["the", "of", "and", "tion", "Été", "straße", "漢字", "x1", "b", "ing", "re", "on", "at", "er"] + [f"w{i}" for i in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("\n" if r.random() < 0.08 else "") for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{seed}" if r.random() < share else w for w in text.split(" "))


BASE = prose(300, 1)
ODD = [None, "", "   \n\t ", "one", "one two three four", "a b c d e", "A B C D E", "x" * 50_000, "\n".join(["same line here"] * 40), "  padded\x0bwords\x0chere\r\nand there  ", "é É é É é É", " nbsp is no space here at all"]


def texts():
    out = [*ODD, BASE, BASE, BASE.upper(), prose(20_000, 2)]
    out += [edited(BASE, s, i) for i, s in enumerate([0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3])]
    out += [prose(n, 10 + n) for n in (4, 5, 34, 35, 36, 70, 200)]
    out += [prose(50, 99) + "\n" + BASE[:900] + "\n" + prose(30, 98), BASE[:900] + " tail " + BASE[:900]]
    return out


def test_word_hashes_tell_words_apart():
    words = [b"abc", b"acb", b"ABC", b"abc", b"a" * 3000, b"a" * 3001, "é".encode()]
    buf, starts, ends, first = hashing.tokens([b" ".join(words), b"", b"abc"])
    h = hashing.Hasher().spans(buf, starts, ends)
    assert h[0] == h[3] == h[7] and len(set(h.tolist())) == 6 and first.tolist() == [0, 7, 7, 8]
    folded = hashing.Hasher(fold=True).spans(buf, starts, ends)
    assert folded[0] == folded[2]
    assert len(set(hashing.rolling(h, 20).tolist())) == 0 and len(hashing.rolling(h, 3)) == 6


def test_minhash(spark, docs_of):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(rows)).collect()}
    want = brute.near(rows)
    assert {k: r.component_id for k, r in got.items()} == want
    for k, t in rows:
        assert got[k].n_shingles == len(brute.shingles(t)) and got[k].kept == (want[k] == k)


def test_minhash_finds_chains_in_a_large_group(spark, docs_of):
    """A group of near copies in which most pairs are under the threshold."""
    rows, text = [], prose(150, 3).split(" ")
    r = random.Random(1)
    for i in range(150):
        text = list(text)
        text[r.randrange(len(text))] = f"n{i}"
        rows.append((i, " ".join(text)))
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs_of(rows).repartition(5)).collect()}
    assert got == brute.near(sorted(rows))


def test_minhash_odd_rows(spark, docs_of):
    rows = [(None, BASE), (None, BASE), (7, BASE), (7, BASE), (3, "q r s"), (3, BASE)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs_of(rows)).collect())
    assert got == [(False, 0, 0, True)] * 2 + [(True, 3, 3, True)] * 2 + [(True, 7, 3, False)] * 2
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_superminhash_estimates_similarity():
    import numpy as np

    sets = [np.arange(1000, dtype=np.uint64), np.arange(150, 1150, dtype=np.uint64), np.arange(3, dtype=np.uint64)]
    sig = minhash.signatures([hashing.mix(s) for s in sets], 128)
    assert abs((sig[0] == sig[1]).mean() - 850 / 1150) < 0.12 and (sig < 128 << 32).all()
    assert (sig[2] >> np.uint64(32)).max() > 10  # three elements fill 128 slots in many steps


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200), (None, 1)]
    links = spark.createDataFrame(chain, "u long, v long").repartition(7)
    got = dict(map(tuple, graph.components(links).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 103: 100, 105: 100}
    assert graph.components(links.limit(0)).collect() == []


@pytest.mark.parametrize("shard_bytes", [8 << 20, 4000])
def test_substrings(spark, docs_of, shard_bytes):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in substring.remove_repeats(docs_of(rows), keep=True, shard_bytes=shard_bytes, bucket_hashes=2000).collect()}
    for k, n, removed, kept in brute.repeats(rows):
        assert (got[k].n_words, got[k].n_removed, got[k].kept, got[k].kept_sha256) == (n, removed, kept, brute.sha(kept)), k


@pytest.mark.parametrize("window", [35, 8, 3, 2])
def test_automaton_decides_which_windows_recur(window, monkeypatch):
    import numpy as np

    r = np.random.default_rng(window)
    for _ in range(20):
        part = r.integers(0, 3, 60).astype(np.uint64)
        rows = [r.integers(0, 4, n).astype(np.uint64) for n in (0, 1, window - 1, window, 150)] + [part, np.concatenate([part[20:], part]), np.zeros(50, np.uint64)]
        counts, words = np.array([len(x) for x in rows]), hashing.mix(np.concatenate(rows))
        hashes, valid = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        rolled = hashing.rolling(words, window)
        hashes[: len(rolled)], valid[: len(rolled)] = rolled, substring.starts(counts, window)
        found, times = np.unique(hashes[valid], return_counts=True)
        known = found[times > 1]
        got = substring.occurrences(words, counts, known, hashes, valid, window)
        assert got.tolist() == np.flatnonzero(valid & np.isin(hashes, known)).tolist()
    monkeypatch.setattr(substring, "compiled", lambda words, places, window: (type("Blind", (), {"iter": lambda self, text: []})(), np.zeros(len(words), np.uint64)))
    assert len(got) and not len(substring.occurrences(words, counts, known, hashes, valid, window))


def test_equal_hashes_of_other_words_are_no_occurrence():
    import numpy as np

    words = hashing.mix(np.arange(8, dtype=np.uint64) % np.uint64(4) + np.array([0] * 7 + [9], np.uint64))
    hashes = np.array([5, 6, 0, 0, 5, 6, 0, 0], np.uint64)  # of windows of three words; those at 1 and 5 differ in the last
    valid = np.array([1, 1, 0, 0, 1, 1, 0, 0], bool)
    got = substring.occurrences(words, np.array([8]), np.array([5, 6], np.uint64), hashes, valid, 3)
    assert got.tolist() == [0, 1, 4]


def test_substrings_repeated_rows_and_empty(spark, docs_of):
    got = substring.remove_repeats(docs_of([(1, BASE), (1, BASE), (None, "a b")])).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(2, 0)] + [(len(BASE.split()), len(BASE.split()))] * 2
    assert substring.remove_repeats(docs_of([])).collect() == []
    import numpy as np

    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64))
    assert (substring.unpack(substring.pack(h)) == h).all() and len(substring.unpack(substring.pack(h[:0]))) == 0


def test_quality(spark, docs_of):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in quality.quality(docs_of(rows)).collect()}
    for k, t in rows:
        assert tuple(got[k])[1:7] == brute.quality(t), k
        assert not (got[k].base_failed and got[k].kept)


def test_quality_texts_and_repeated_ids(spark):
    line = "one line of many that all of these documents have"
    body = lambda i: "\n".join(prose(9, 5000 + 20 * i + j).replace("\n", "") for j in range(5))
    rows = [(1, f"{line}\n{body(i)}", "a") for i in range(12)] + [(i, f"{line}\n\n{body(i)}", "b") for i in range(20, 32)] + [(20, f"{line}\n\n{body(20)}", "b"), (None, None, "b")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lines string").repartition(3)
    got = quality.quality(docs, quality.LineLimits(docs=12), texts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 1:  # rows of one id are one document, so the line isn't common
            assert r.removed_chars == 0 and line in r.text
        elif r.doc_id is not None:
            assert r.removed_chars == len(line.replace(" ", "")) and r.text == f"\n{body(r.doc_id)}" and r.kept
        else:
            assert r.text is None and r.base_failed


def test_quality_common_lines(spark):
    common = "this line stands in every document of one host"
    own = lambda i: "\n".join(prose(9, 1000 + 20 * i + j).replace("\n", "") for j in range(6))
    rows = [(i, f"{common} {i}\n" * 9 + own(i), "a") for i in range(12)] + [(20 + i, f"{common} 5\n{own(20 + i)}", "b") for i in range(12)] + [(50, common, None), (51, own(51), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(docs, quality.LineLimits(docs=12, depleted=0.5)).collect()}
    assert all(got[i].removed_chars == 9 * len(f"{common}{i}".replace(" ", "")) and not got[i].kept for i in range(12))  # digits are alike
    assert all(got[20 + i].kept and got[20 + i].removed_chars > 0 for i in range(12)) and got[51].kept and got[50].removed_chars == 0
    assert quality.quality(docs.limit(0)).collect() == []


ITEMS = [(1, prose(40, 50)), (2, " ".join(prose(40, 50).split()[5:30])), (3, "Only five Words are here"), (4, "..."), (5, None), (None, prose(15, 51)), (1, prose(12, 52)), (6, "straße Été")]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, docs_of, broadcast):
    rows = [*enumerate(texts())]
    n = len(rows)
    for i, (_, t) in enumerate(ITEMS):
        w = (t or "").split()
        rows += [(n + 5 * i, prose(30, i) + " " + " ".join(w[:12]).upper() + ", " + prose(9, i)), (n + 5 * i + 1, ";".join(w[3:13])), (n + 5 * i + 2, " ".join(w[3:12])), (n + 5 * i + 3, f"a {t} b {t}")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.decontaminate(docs_of(rows), items, broadcast).collect()}
    assert got == {x[0]: x[1:] for x in brute.leaks(rows, ITEMS)}


def test_decontamination_of_nothing(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([]), items).collect() == []
    assert decontaminate.decontaminate(docs_of(["a b"]), items.limit(0)).first().n_hit == 0
    assert len(decontaminate.decontaminate(docs_of([(1, "a"), (1, "a"), (None, None)]), items).collect()) == 3


def test_lines(spark, docs_of):
    a, b = "l1 x\nl2 x\nl3 x\nl4 x", "l2  x\n l3 x\nl4 x\n\nl5 x"
    rows = [*enumerate([*ODD, a, b, a, "l1 x\n\n l2 x\n \nl3 x\nnew", "l3 x\nl4 x", prose(3000, 7)]), (900, prose(3000, 7))]
    got = {r.doc_id: r for r in linededup.line_dedup(docs_of(rows)).collect()}
    for k, n, deleted, kept in brute.later_runs(rows):
        assert (got[k].n_lines, got[k].n_deleted, got[k].text) == (n, deleted, kept), k
    three = {r.doc_id: r.text for r in linededup.line_dedup(docs_of(rows), words=None).collect()}
    assert three == {x[0]: x[3] for x in brute.later_runs(rows, words=None)}
    assert linededup.line_dedup(docs_of([])).collect() == []
    twice = linededup.line_dedup(docs_of([(1, a), (1, a)])).collect()
    assert [r.n_deleted for r in twice] == [0, 0] and twice[0]["row"] == "x"  # one document


def test_passages_of_one_and_two_lines(spark, docs_of):
    line = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    long, half, few, rest = line(51, "a"), line(30, "b"), line(21, "c"), line(50, "d")
    rows = [(1, f"{long}\nown 1"), (2, f"own 2\n\n {long}"), (3, f"{half}\n{few}"), (4, f"{half}\n \n{few}\nown 4"), (5, f"{rest}\nown 5"), (6, f"{rest}\nown 6"), (7, f"{long}\n{few}"), (8, f"{long}\n{few}"), (9, None)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in linededup.line_dedup(docs_of(rows)).collect()}
    assert got == {
        1: (2, 0, rows[0][1]), 2: (2, 1, "own 2\n"), 3: (2, 0, rows[2][1]), 4: (3, 2, " \nown 4"), 5: (2, 0, rows[4][1]), 6: (2, 0, rows[5][1]),
        7: (2, 1, few), 8: (2, 2, ""), 9: (0, 0, None),
    }
    assert all(r.n_deleted == 0 for r in linededup.line_dedup(docs_of(rows), words=None).collect())  # three lines at least


def test_lines_are_found_by_their_fingerprints(spark, docs_of, monkeypatch):
    text = "l1 x\nl2 x\nl3 x\nl4 x"
    assert sum(r.n_deleted for r in linededup.line_dedup(docs_of([text, text])).collect()) == 4
    none = F.array().cast("array<struct<place:int,before:int,around:array<struct<h:bigint,n:int>>>>")
    monkeypatch.setattr(linededup, "fingerprints", lambda *_: none)
    assert sum(r.n_deleted for r in linededup.line_dedup(docs_of([text, text])).collect()) == 0


def test_lines_with_clashing_columns(spark):
    text = "l1 x\nl2 x\nl3 x"
    docs = spark.createDataFrame([(i, text, "a", "b", "c", 7) for i in (1, 2)], "doc_id long, text string, _row string, _of string, _gone string, n_deleted int")
    got = sorted(map(tuple, linededup.line_dedup(docs).collect()))
    assert got == [(1, text, "a", "b", "c", 3, 0), (2, "", "a", "b", "c", 3, 3)]


def test_bpe_is_tiktoken(spark, docs_of):
    import public_tokenizers
    import tiktoken

    data = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    rows = [*enumerate([*texts(), "".join(rnd.choice("abcdeilnorst") for _ in range(3000)), "👍🏽 <|endoftext|> 123456 don't", "!" * 999])]
    for r in bpe.encode_decode(docs_of(rows), data, public_tokenizers.PATTERN, keep=True).collect():
        text = dict(rows)[r.doc_id] or ""
        assert (r.ids, r.n_tokens, r.decoded) == (plain.encode_ordinary(text), len(r.ids), text)
        assert r.decoded_sha256 == brute.sha(text)
    assert bpe.encode_decode(docs_of([]), data, public_tokenizers.PATTERN).collect() == []


def test_bpe_of_a_small_vocabulary_is_plain_merging():
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate([b"ab", b"bc", b"abc", b"aa", b"aab", b"cab", b"ca", b"aaaa", b"bca"])}
    codec = bpe.Bpe(ranks, r"\S+|\s+")
    for _ in range(3000):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
        assert codec.encode_piece(data) == ([ranks[data]] if data in ranks else codec._merge(data, len(ranks) + 1)), data


def test_language(spark, docs_of):
    words = {"en": ["the", "and", "thing", "other"], "de": ["der", "und", "straße", "nicht"], "fr": ["été", "les", "avec", "nous"]}
    rows = [(i, " ".join(random.Random(i).choices(words[k], k=30)), k) for i in range(60) for k in [["en", "de", "fr"][i % 3]]]
    rows += [(100, None, "en"), (101, "123 ... !", "de"), (102, "", None), (None, "the thing", "en"), (103, "x" * 100_000, None), (104, "und und der", None), (104, "und und der", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.language(docs).collect()}
    pred = {k: p for k, p, _ in got}
    assert all(pred[i] == k for i, _, k in rows[:60]) and pred[104] == "de"
    assert pred[100] == pred[101] == pred[102] == "und" and dict((k, h) for k, _, h in got)[None] is True
    assert all(0 <= r.score <= 1 for r in langid.language(docs).collect())
    assert langid.language(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_is_the_plain_version(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, "\U00031350\U00031351", None), (-2, "1 2 3", "en"), (-3, "x" * 3000 + " Été", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.language(docs.repartition(5)).collect()}
    assert got == {k: (lang, round(score, 9)) for k, (lang, score) in brute.languages(rows).items()}
    assert got[-1][0] != "und" and got[-2] == ("und", 0)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred != 'und'")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95, right


def test_language_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the thing", "en", 5, "x"), (1, "the thing", "en", 5, "x")], "doc_id long, text string, lang string, score int, lang_pred string")
    out = langid.identify(docs, langid.learn(docs)).collect()
    assert [(r.doc_id, r.lang_pred) for r in out] == [(1, "en")] * 2 and len(out[0]) == 5


def test_language_never_learns_from_held_out_rows(spark):
    import zlib

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, "der die das", "xx") for i in ids], "doc_id long, text string, lang string")
    assert {(r.held_out, r.lang_pred) for r in langid.language(docs).collect()} == {(True, "und")}


def test_warc(spark):
    big = "<p>" + "grün " * 40
    html = [(5, big), (3, big), (9, big), (1, "short"), (2, "short"), (4, None), (6, "line\r\n\r\nWARC/1.1\r\n" * 30), (7, "line\r\n\r\nWARC/1.1\r\n" * 30), (8, "z" * 300_000), (None, big)]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://h{i}/a\r\nX: y", h, "clash") for i, h in html], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.captures(pages).collect()}
    assert len(got) == len(html)
    for i, h in html:
        r, data = got[i], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), brute.sha(h or "")) and r.has_request and r.has_metadata
        first = min(k for k, x in html if x == h and k is not None)
        revisit = len(data) >= 100 and first != i
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert warc.captures(pages.limit(0)).collect() == []
    same = [tuple(r) for r in warc.captures(pages.where("page_id = 3").unionByName(pages.where("page_id = 3")).unionByName(pages.where("page_id = 9"))).collect()]
    assert sorted((r[0], r[3], r[4]) for r in same) == [(3, "response", None), (3, "response", None), (9, "revisit", 3)]


def test_warc_text_is_what_the_format_says(spark):
    import gzip

    pages = spark.createDataFrame([(1, "http://h/", "héllo")], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_warc(pages, path)
    data = b"".join(r.content for r in spark.read.format("binaryFile").load(path).collect())
    records = list(warc.parse(warc.unpacked(data)))
    assert [f["warc-type"] for f, _ in records] == ["request", "response", "metadata"]
    assert records[1][1].endswith("\r\n\r\nhéllo".encode()) and records[0][0]["warc-concurrent-to"] == records[1][0]["warc-record-id"]
    whole = gzip.decompress(data)
    parts = [x + b"\r\n\r\n" for x in whole.split(b"\r\n\r\nWARC/")]
    members = b"".join(gzip.compress(x if i == 0 else b"WARC/" + x) for i, x in enumerate(parts))
    assert [b for _, b in warc.parse(warc.unpacked(members, 7))] == [b for _, b in records]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(iter([whole[:-8]])))
    full = warc.assemble(warc.read_warc(spark, path)).first()
    assert bytes(full.response.payload) == "héllo".encode() and full.request.kind == "request"
    alone = warc.assemble(warc.read_warc(spark, path).where("kind = 'metadata'")).first()
    assert alone.response is None and alone.metadata is not None


def test_licences(spark):
    text = "x y z\nLicensed under the Apache License, Version 2.0.\nmore"
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/f.txt", None), ("a/b/g.txt", text), ("a/b/h.txt", "no licence to be vague about these entirely different words"), ("top.txt", ""), ("z/q.txt", "prose"), ("a/b/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."), (None, "All rights reserved."), ("a/k.txt", "prose"), ("ab/k.txt", "prose"), ("a/k.txt", "prose")]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "path string, text string, licence string")
    got = {(r.path, r.licence, r.how, r.licence_from) for r in licenses.scan(files).collect()}
    assert got == {
        ("a/LICENSE", "MIT", "own", None), ("a/b/c/f.txt", "GPL-3.0", "inherited", "a/b"), ("a/b/g.txt", "Apache-2.0", "own", None), ("a/b/h.txt", "GPL-3.0", "inherited", "a/b"),
        ("top.txt", None, "none", None), ("z/q.txt", None, "none", None), ("a/b/LICENSE.md", "GPL-3.0", "own", None), (None, "Proprietary", "own", None), ("a/k.txt", "MIT", "inherited", "a"), ("ab/k.txt", None, "none", None),
    }
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.limit(0)).collect() == []


def test_whole_licences(spark):
    held = {(k, i): t for i, (k, t, _) in enumerate(licenses.whole_templates())}
    by = {}
    for (k, _), t in held.items():
        by.setdefault(k, []).append(t)  # the full text first, or the header
    header = {k: next(t for t in by[k] if 30 < len(t.split()) < 250) for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")}
    commented = lambda t: "#!/bin/sh\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n" + prose(300, 3)
    want = [(k, commented(t)) for k, t in header.items()]
    want += [(k, max(by[k], key=len)) for k in by if max(map(len, by[k])) > 500]
    want += [(k, "Copyright 2020 The Owner. All rights reserved.\n\n" + max(by[k], key=len) + "\n" + prose(200, 4)) for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]
    want += [("MIT", "/* SPDX-License-Identifier: MIT */\nint x;"), (None, "// SPDX-License-Identifier: Other-1.0\nint x;"), (None, "the seats are reserved for us"), (None, prose(500, 5)), (None, None), (None, "")]
    want += [("MIT", prose(150, 6).replace("\n", " ") + " It was Released under the MIT License. " + prose(150, 7).replace("\n", " ")), ("Proprietary", "x y\nAll rights reserved.\nz")]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)] + [(1000 + i, prose(60, 100 + i)) for i in range(300)], "row long, text string")
    got = {r.row: r.licence for r in licenses.whole_licences(rows).collect()}
    assert got == {i: k for i, (k, _) in enumerate(want) if k}
    files = spark.createDataFrame([("a/LICENSE", max(by["MIT"], key=len)), ("a/b/f.txt", "prose")], "path string, text string")
    assert {(r.path, r.licence, r.how) for r in licenses.scan(files, whole=True).collect()} == {("a/LICENSE", "MIT", "own"), ("a/b/f.txt", "MIT", "inherited")}
    assert licenses.scan(files.limit(0), whole=True).collect() == []
    assert {r.how for r in licenses.scan(files).collect()} == {"none"}  # lines with a cue alone


def test_sharding(spark, docs_of):
    rows = [(i if i % 50 else None, prose(20, i)) for i in range(400)]
    docs = docs_of(rows).withColumn("_arrival", F.lit("clash")).repartition(6)
    root = scratch(spark, "shards-test")
    store, out = sharding.store_and_read(docs, root, arrivals=5, target_bytes=40_000)
    names = docs.columns
    assert sorted(map(str, out.select(*names).collect())) == sorted(map(str, docs.collect()))
    live = store.shards()
    assert store.version() >= 5 and sum(s.rows for s in live) == 400 and len(live) < 30 and not store.plan(live)
    assert max(s.bytes for s in live) < 80_000
    before = store.version()
    store.append(docs.limit(3))
    assert store.version() == before + 1 and store.read().count() == 403 and sum(s.rows for s in store.shards(before)) == 400
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit([], before)
    empty, found = sharding.store_and_read(docs.limit(0), scratch(spark, "shards-empty"))
    assert found.collect() == [] and empty.version() == 0 and empty.read() is None


def test_writers_of_one_version_and_retention(spark, docs_of):
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.ShardStore(spark, scratch(spark, "shards-race"), target_bytes=40_000)

    def tried(at):
        try:
            return store.commit([], at)
        except RuntimeError as e:
            return str(e)

    for at in range(5):
        with ThreadPoolExecutor(8) as pool:
            got = list(pool.map(tried, [at] * 8))
        assert sorted(map(str, got)) == [str(at + 1)] + [f"version {at + 1} was committed by another writer"] * 7
    names = [s.getPath().getName() for s in store.fs.listStatus(store._path(f"{store.root}/manifest"))]
    assert sorted(names) == [f"v{v:08d}.json" for v in range(1, 6)]

    rows = docs_of([(i, prose(20, i)) for i in range(100)]).repartition(4)
    old = store.append(rows, F.pmod(F.col("doc_id"), F.lit(5)))
    assert store.compact() and store.read(old).count() == store.read().count() == 100
    replaced = {s.path for s in store.shards(old)} - {s.path for s in store.shards()}
    assert store.vacuum(versions=1) == len(replaced) > 0 and store.vacuum(versions=1) == 0
    assert store.read().count() == 100 and not any(store.fs.exists(store._path(p)) for p in replaced)
    with pytest.raises(ValueError):
        store.vacuum(0)


def test_commit_by_rename_does_not_overwrite(spark, monkeypatch):
    """The way of file systems that aren't local, here on a local one."""
    monkeypatch.setattr(sharding.ShardStore, "_place", sharding.ShardStore._rename)
    store = sharding.ShardStore(spark, scratch(spark, "shards-rename"))
    assert store.commit([sharding.Shard("a", 1, 1)], 0) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit([], 0)
    assert store.version() == 1 and store.shards() == [sharding.Shard("a", 1, 1)]


def test_compaction_plan():
    store = sharding.ShardStore.__new__(sharding.ShardStore)
    store.target, store.fan_in, store.base = 100, 4, 2
    shard = lambda n, b: [sharding.Shard(f"{b}-{i}", 1, b) for i in range(n)]
    assert store.plan(shard(3, 2)) == [] and [len(g) for g in store.plan(shard(5, 2))] == [5]
    assert [len(g) for g in store.plan(shard(9, 40))] == [2, 2, 2, 2] and store.plan(shard(9, 80)) == []
    assert store.tier(2) == 0 and store.tier(8) == 1 and store.tier(9) == 2
