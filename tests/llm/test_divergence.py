"""The audit of sources against plain Python, and the pointer sort against sorting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlink.llm import arrays, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least, best):
    rows = [(terms_of(t), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        held = Counter(x for words, _, _ in mine for x in set(words))
        kept = sorted(x for x, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for words, _, source in mine:
            counts[source].update(x for x in words if held[x] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {x: 1 + 1000000000 * (c[x] + 2) // total for x in kept}

        share, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(apart(share[s][x], share[t][x]) for x in kept), t) for t in counts if t != s]
            found = [(apart(share[s][x], q[x]), x) for x in kept if counts[s][x] and share[s][x] > q[x]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", found, best)):
                items.sort(key=lambda i: (-i[0], i[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(items[:most], 1)}
    return out


def corpus(seed, many):
    draw = random.Random(seed)
    vocabulary = ["a", "été", "incomprehensible", "incomprehensibly", "incompre", "日本語テキスト", "Zebra", "x" * 40, "x" * 41] + [f"q{chr(97 + i)}" for i in range(20)]
    sources = [f"s{i}" for i in range(9)] + [None, "", "è"]
    rows = []
    for _ in range(many):
        source = draw.randrange(len(sources))
        words = [draw.choice(vocabulary[source % 7 :]) for _ in range(draw.randint(0, 30))]
        rows.append((draw.choice([" ", "1", ", ", "\x00"]).join(words), draw.choice(["en", "en", "fr", None]), sources[source]))
    return rows + [("none none", "xx", "lonely"), (None, "xx", "other"), ("zz", "fr", "rare only"), ("the " * 9000, "en", "s1")]


@pytest.mark.parametrize("seed,least,tile,block", [(1, 10, 64, 4096), (2, 3, 2, 4), (3, 1, 3, 7), (4, 50, 64, 1)])
def test_the_audit_equals_plain_python(spark, odd, monkeypatch, seed, least, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = corpus(seed, 160) + [(t, "de", "odd") for t in odd]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).repartition(5)
    assert {tuple(r) for r in divergence.audit(docs, least, 10).collect()} == brute(rows, least, 10)
    assert divergence.audit(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_pointers_are_sorted_by_tokens(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("ab") for _ in range(draw.choice([1, 3, 7, 8, 9, 16, 17, 30]))) for _ in range(300)] + ["é" * 13] * 5
    text = next(arrays.chunks(pa.array([" ".join(words)])))
    found = arrays.words(text, divergence._OTHER)
    data = np.concatenate([text.data, np.zeros(divergence.SLICE, np.uint8)])
    order, run = divergence.sorted_pointers(data, found.starts, found.ends)
    raw = [data[a:b].tobytes() for a, b in zip(found.starts, found.ends)]
    assert [raw[i] for i in order] == sorted(raw)
    assert run.tolist() == [sorted(set(raw)).index(raw[i]) for i in order]
