"""Collocations against counting everything in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlink.llm import collocations as C


def brute(rows, longest, threshold, inside, best):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if len(p) > 2 and a >= threshold}
    found = []
    for (lang, *words), a in frequent.items():
        inner = any(
            q[0] == lang and len(q) > len(words) + 1 and 100 * b >= inside * a and any(list(q[1 + i : 1 + i + len(words)]) == words for i in range(len(q) - len(words)))
            for q, b in frequent.items()
        )
        if inner:
            continue
        score, _, left, right = min(
            (1000000 * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k, counts[(lang, *words[:k])], counts[(lang, *words[k:])])
            for k in range(1, len(words))
        )
        found.append((lang, score, a, " ".join(words), left, right))
    out = set()
    for lang in totals:
        mine = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[1], -f[2], f[3].encode()))
        out |= {(lang, i, p, a, left, right, totals[lang], s) for i, (_, s, a, p, left, right) in enumerate(mine[:best], 1)}
    return out


def corpus(seed, many):
    draw = random.Random(seed)
    vocabulary = ["new", "york", "City", "the", "été", "of", "日本", "\x00x", "😀", "A"] + [f"w{i}" for i in range(30)]
    breaks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!"]
    rows = []
    for _ in range(many):
        text = "".join(draw.choice(vocabulary[: draw.choice([5, 12, 40])]) + draw.choice(breaks) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "fr", None]), text + draw.choice(["", "new york city", "new york  city."])))
    return rows


@pytest.mark.parametrize("seed,longest,threshold,best", [(1, 3, 10, 2000), (2, 3, 3, 25), (3, 2, 5, 2000), (4, 5, 4, 2000)])
def test_phrases_equal_those_of_counting_everything(spark, odd, seed, longest, threshold, best):
    rows = corpus(seed, 200) + [("en", t) for t in odd] + [("fr", "new york city")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(5)
    got = C.collocations(docs, longest, threshold, 50, best)
    assert {tuple(r) for r in got.collect()} == brute(rows, longest, threshold, 50, best)
    assert C.collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("capacity", [1, 7, 50, 400, 5000])
def test_a_summary_keeps_every_frequent_key_whatever_its_capacity(capacity):
    draw = np.random.default_rng(capacity)
    keys = np.concatenate([np.repeat(np.arange(60), np.arange(60)), draw.integers(1000, 9000, 4000)]).astype(np.uint64)
    draw.shuffle(keys)
    summary = C.Summary(capacity, 10)
    for part in np.array_split(keys, 23):
        summary.add(*np.unique(part, return_counts=True))
    real = dict(zip(*np.unique(keys, return_counts=True)))
    kept = dict(zip(summary.keys, summary.counts))
    assert summary.taken < 10
    assert {k for k, n in real.items() if n >= 10} <= set(kept)
    assert all(n - summary.taken <= kept.get(k, 0) <= n for k, n in real.items())


def test_small_summaries_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    rows = corpus(9, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for name, value in (("MASS", 40), ("MOST_BITS", 8), ("LEAST_BITS", 8), ("HELD", 100), ("CHUNK", 500)):
        monkeypatch.setattr(C, name, value)
    assert {tuple(r) for r in C.collocations(docs, 3, 6).collect()} == brute(rows, 3, 6, 50, 2000)


def test_scores_of_large_counts_are_exact(spark):
    a, left, right = 10**12 + 7, 10**12 + 11, 3 * 10**13 + 1
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    exact = [F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")]
    found = row.select((exact[0] * exact[0] * F.lit(1000000)).alias("x"), (exact[1] * exact[2]).alias("y")).select(F.expr("x div y"))
    assert found.collect()[0][0] == 1000000 * a * a // (left * right)
