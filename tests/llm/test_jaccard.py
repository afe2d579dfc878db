"""The Jaccard join and its components against comparing all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flowlink.llm import jaccard
from flowlink.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def united(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    whole = united(ids, links)
    return {(i, len(sets[i]), whole[i]) for i in ids}


def corpus(seed, many, longest):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[draw.choice(vocabulary) for _ in range(draw.randint(1, longest))] for _ in range(many // 3)]
    texts.append([f"hot{i}" for i in range(longest)])
    while len(texts) < many:
        words = list(draw.choice(texts + texts[-1:] * 10))
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(words + [draw.choice(vocabulary)] * draw.randint(0, 1))
    return [(100 + i, " ".join(w.upper() if draw.random() < 0.1 else w for w in words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize("seed,k,percent,longest", [(1, 3, 90, 30), (2, 3, 80, 14), (3, 1, 50, 8), (4, 5, 80, 200), (5, 2, 100, 10)])
def test_components_equal_those_of_all_pairs(spark, seed, k, percent, longest):
    rows = corpus(seed, 90, longest)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {tuple(r) for r in jaccard.link_components(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("limit", [0, 5, 15, 10_000])
def test_any_boundary_between_small_and_large_is_right(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "boundary", lambda sets, percent: limit)
    rows = corpus(7, 70, 25)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in jaccard.link_components(docs, 2, 80).collect()} == brute(rows, 2, 80)


def test_odd_texts_ties_nulls_and_other_columns(spark, odd):
    rows = [(i, t, "x") for i, t in enumerate(odd + odd)] + [(None, "the the", "x"), (5, odd[5], "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    got = jaccard.link_components(docs).collect()
    assert len(got) == len(rows)
    want = {i: c for i, _, c in brute([(i, t) for i, t, _ in rows[: 2 * len(odd)]], 3, 90)}
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert jaccard.link_components(docs.limit(0)).collect() == []


def test_union_find_on_chains_stars_and_loops(spark):
    draw = random.Random(2)
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, i) for i in range(1001, 1400)]
    loops = [(5000, 5000), (6001, 6000), (6000, 6001)]
    mess = [(draw.randint(7000, 7100), draw.randint(7000, 7100)) for _ in range(60)]
    links = chain + star + loops + mess
    draw.shuffle(links)
    edges = spark.createDataFrame(links, "u bigint, v bigint").repartition(4)
    got = {(r["node"], r["component"]) for r in components(edges).distinct().collect()}
    proper = [(a, b) for a, b in links if a != b]
    assert got == set(united({n for l in proper for n in l}, proper).items())
    assert components(edges.filter(F.lit(False))).collect() == []
