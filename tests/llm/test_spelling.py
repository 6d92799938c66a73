"""Spelling variants against all pairs of words and a walk of forms."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from ionframe.llm import ranged, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(docs):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def grouped(counts):
    of = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in of.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(of[w]), form[w], counts.get(form[w]), root))
    return out


def small_parts(monkeypatch, n):
    monkeypatch.setattr(spelling, "range_sorted", lambda df, keys, rows: ranged.range_sorted(df, keys, rows, n))


def word_list(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé", k=rng.randint(7, 11))) for _ in range(25)]
    counts = {}
    for s in stems:
        counts[s] = rng.choice([2, 30, 400, 5000])
        for _ in range(12):
            k = rng.randrange(len(s))
            v = rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abéz") + s[k:], s[:k] + rng.choice("abéz") + s[k + 1 :], s + "a"])
            if len(v) >= 7:
                counts.setdefault(v, rng.choice([2, 3, 25, 300]))
    counts |= {"aaaaaaa": 9, "aaaaaaaa": 90, "aaaaaaaaa": 900, "a" * 3000: 2, "a" * 2999: 20, "b" + "a" * 2999: 4}
    return counts


@pytest.mark.parametrize(("seed", "rows"), [(1, 5), (2, 40), (3, 10_000)])
def test_variants_equal_all_pairs(spark, monkeypatch, seed, rows):
    small_parts(monkeypatch, rows)
    counts = word_list(seed)
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()} == grouped(counts)


def test_documents(spark):
    rng = random.Random(7)
    stems = ["".join(rng.choices("abcdeé", k=rng.randint(6, 10))) for _ in range(60)]
    docs = [(k, " ".join(rng.choice(stems) if rng.random() < 0.9 else rng.choice(stems)[:-1] + rng.choice("xyÿ×") for _ in range(60)).replace("a", "A")) for k in range(60)]
    docs += [(None, "notext1 Anything anything"), (61, None), (62, ""), (63, "anything ÉCOLESSE ÉCOLESSE écolesse x" + "y" * 9000 + "1x" + "y" * 9000), (5, docs[5][1])]
    frame = spark.createDataFrame([(k, t, "w", 9) for k, t in docs], "doc_id long, text string, word string, n int")
    counts = counted(docs)
    assert {(r["word"], r["n"]) for r in spelling.word_counts(frame).collect()} == set(counts.items())
    got = spelling.spelling_variants(frame)
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()} == grouped(counts)


def test_no_rows(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_light_edges_halve(spark):
    """No word has more light edges than the logarithm of the number of words."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("ab", k=12)) for _ in range(2000)})
    most = max(len(edges) for _, edges in spelling.Stretch(words, -1, -1).light_edges({}))
    assert most <= len(words).bit_length()
