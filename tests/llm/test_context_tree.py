"""Context-tree weighting against its definition, worked out node by node."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlink.llm import arrays as A
from flowlink.llm import context_tree as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def coded(text, depth):
    data = [255] * depth + list(lower(text).encode()) + [255]
    return [(tuple(data[i - depth : i]), data[i]) for i in range(depth, len(data))]


def tree_of(texts, depth):
    """(context, node) -> [zeros, ones], contexts from the last byte backwards."""
    tree = {}
    for text in texts:
        for context, byte in coded(text, depth):
            add(tree, context, byte, depth)
    return tree


def add(tree, context, byte, depth):
    for bit in range(8):
        node, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
        for d in range(depth + 1):
            tree.setdefault((context[len(context) - d :], node), [0, 0])[one] += 1


def log_weighted(tree, context, node, depth):
    a, b = tree.get((context, node), (0, 0))
    own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    if len(context) == depth:
        return own
    below = sum(log_weighted(tree, c, node, depth) for (c, n) in tree if n == node and len(c) == len(context) + 1 and c[1:] == context)
    return math.log(0.5) + np.logaddexp(own, below)


def brute_score(texts, text, depth):
    """The frozen tree's code length: how much each bit would change its weighted probability."""
    tree, total = tree_of(texts, depth), 0.0
    known = {}
    for context, byte in coded(text, depth):
        if (context, byte) not in known:
            grown = {k: list(v) for k, v in tree.items()}
            add(grown, context, byte, depth)
            nodes = [(1 << bit) | (byte >> (8 - bit)) for bit in range(8)]
            known[context, byte] = sum(log_weighted(grown, (), n, depth) - log_weighted(tree, (), n, depth) for n in nodes)
        total += known[context, byte]
    return total / math.log(10)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.5, 100.5, 1e6 + 0.5])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_grams_stay_in_their_rows():
    text = next(A.chunks(pa.array(["ab", "", "C", None])))
    key, row = C.grams(text, 2)
    want = [(c[0] << 16 | c[1] << 8 | b, i) for i, t in enumerate(["ab", "", "C", ""]) for c, b in coded(t, 2)]
    assert list(zip(key.tolist(), row.tolist())) == want


@pytest.mark.parametrize("depth,block", [(2, 1000), (3, 1000), (3, 5)])
def test_scores_match_the_definition(docs_of, depth, block):
    texts = ["abab ba", "Abba ab", "", None, "zé ab", "abab ba"]
    docs = docs_of(texts)
    out = {r["doc_id"]: r for r in C.score_texts(docs, depth=depth, block=block, head=2).collect()}
    held = {i for i in range(len(texts)) if out[i]["held_out"]}
    learn = [t for i, t in enumerate(texts) if i not in held]
    for i, text in enumerate(texts):
        assert out[i]["score"] == pytest.approx(brute_score(learn, text, depth), rel=1e-5)


def test_base_counts_match_plain_python(docs_of, odd):
    import zlib

    texts = ["the cat sat", "The dog sat on the mat", "a cat", "", None, "unseen words here", "the", "on on on"] * 3 + odd
    docs = docs_of(texts)
    learn = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    count = Counter(w for t in learn for w in [*WORD.findall(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for head in (0, 3, 1000):
        got = {r["doc_id"]: r for r in C.score_texts(docs, depth=2, head=head).collect()}
        assert len(got) == len(texts)
        for i, words in enumerate(tokens):
            r = got[i]
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
            assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
            assert r["n_known"] == sum(count[w] > 0 for w in words)
            assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
            assert r["score"] < 0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, "c", 1), (4, None, 1)], "doc_id bigint, text string, score int")
    got = C.score_texts(docs, depth=2, block=3).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "4", "None"]
    same = [r for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]
    assert C.score_texts(docs.limit(0)).collect() == []


def test_all_held_out_costs_a_bit_per_bit(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    r = C.score_texts(docs, learn=F.lit(False)).collect()[0]
    assert r["score"] == pytest.approx(24 * math.log10(0.5))
    assert (r["n_known"], r["train_tokens"]) == (0, 0)
