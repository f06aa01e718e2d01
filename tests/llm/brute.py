"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows):
    """[(doc_id, text)] -> {doc_id: component}"""
    sets = [(k, shingles(t)) for k, t in rows]
    up = {k: k for k, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k, _ in sets}


def repeats(rows, window=35):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept)]"""
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def leaks(docs, items, size=10):
    """[(doc_id, n_words, n_hit, n_items, digest, contaminated)]"""
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(lower(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for k, text in docs:
        w, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        found.discard(None)
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def later_runs(rows, run=3, words=50):
    """[(doc_id, text)] in order of id -> [(doc_id, n_lines, n_deleted, kept)]; runs shorter than ``run`` lines have more
    than ``words`` words, if it is given."""
    seen, out = set(), []
    for k, text in rows:
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if WORD.search(x)]
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", lines[i]).strip(" ") for i in solid]
        gone = set()
        for size in range(1 if words is not None else run, run + 1):
            for i in range(len(norm) - size + 1):
                key = tuple(norm[i : i + size])
                if size < run and sum(len(x.split(" ")) for x in key) <= words:
                    continue
                if key in seen:
                    gone |= {solid[j] for j in range(i, i + size)}
                seen.add(key)
        out.append((k, len(solid), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def letters(text):
    return any(c.isalpha() for c in text or "")


def profile(text, most):
    """The most frequent n-grams, by falling count and then by their characters; the gap between words is \x01."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    seen = Counter()
    for w in words:
        padded = f"\x01{w}\x01"
        seen.update(w)
        seen.update(padded[i : i + 2] for i in range(len(padded) - 1))
        seen.update(padded[i : i + 3] for i in range(len(padded) - 2))
    order = lambda g: [ord(c) for c in g.rjust(3, "\x00")]
    return sorted(seen, key=lambda g: (-seen[g], order(g)))[:most], seen


def languages(rows, kept=400, compared=300):
    """[(doc_id, text, lang)] -> {doc_id: (lang_pred, score)}, learned from the ids whose crc32 doesn't leave 1 modulo 3."""
    import zlib

    held = lambda k: k is None or zlib.crc32(str(k).encode()) % 3 == 1
    counts = defaultdict(Counter)
    for k, text, lang in rows:
        if not held(k) and text is not None and lang is not None and letters(text):
            counts[lang].update(profile(text, None)[1])
    order = lambda g: [ord(c) for c in g.rjust(3, "\x00")]
    ranks = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], order(g)))[:kept])} for lang, c in sorted(counts.items())}
    out = {}
    for k, text, _ in rows:
        if not letters(text) or not ranks:
            out[k] = ("und", 0.0)
            continue
        own = profile(text, compared)[0]
        far = {lang: sum(abs(r[g] - i) if g in r else kept for i, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        out[k] = (best, max(0.0, 1 - far[best] / (kept * len(own))))
    return out
