"""Small tables of awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, score string"
PROSE = " ".join(f"word{i} and thing{i % 7}" for i in range(60))


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \t\n ", None, "a"),
        (None, "text without an id " * 10, "en", "a"), (None, None, None, None), (6, PROSE + " tail", "en", "b"), (7, "x" * 200_000, "de", "b"),
        (8, PROSE * 40, "en", "b"), (9, "ÉCOLE été ß 北京 " * 30, "fr", "b"), (10, "one two three", "en", "a"), (11, "One  two\nthree", "en", "a"), (12, "# $ | <> " * 30, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "clash", "clash", "clash") for i, t, la, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return (text or "").translate(LOWER)


def shingle_set(text, k):
    w = space_words(ascii_lower(text))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(texts: dict[int, str], k=4, num=85, den=100) -> dict[int, int]:
    sets, parent = {i: shingle_set(t, k) for i, t in texts.items()}, {i: i for i in texts}
    holders, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in ids[a + 1 :]:
                shared[ids[a], b] += 1

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hits(text, items: dict[int, str], size=10):
    """n_words, n_hit and the items hit."""
    windows = defaultdict(set)
    for i, t in items.items():
        w = re.findall(BENCH_WORDS, ascii_lower(t))
        if w:
            for j in range(max(1, len(w) - size + 1)):
                windows[tuple(w[j : j + size])].add(i)
    w, hit, found = re.findall(BENCH_WORDS, ascii_lower(text)), set(), set()
    for n in {len(x) for x in windows}:
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in windows:
                hit.update(range(j, j + n))
                found |= windows[tuple(w[j : j + n])]
    return len(w), len(hit), sorted(map(str, found))


def base_counts(text):
    w = space_words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)
