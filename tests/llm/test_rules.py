"""Counted quality rules against plain Python, and the model on held-out rows."""

import random
import re

import numpy as np
import pyarrow as pa

from flowlink.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            marked |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def blank():
    return rules.Model(np.zeros(rules.BUCKETS, np.float32), 0.0, 1.0, 0.0)


def test_counts_match_plain_python(odd):
    draw = random.Random(1)
    texts = [t for t in odd if t is None or len(t) < 5000] + [
        "".join(draw.choice(["a", "b", "c ", " ", "\n", "é", "#", "\r\n"]) for _ in range(draw.randint(0, 400))) for _ in range(150)
    ]
    got = rules.measured(pa.array(texts, pa.string()), blank())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    columns = [got.field(n).to_pylist() for n in names]
    assert [tuple(c[i] for c in columns) for i in range(len(texts))] == [brute(t) for t in texts]


def test_slices_of_a_batch_are_counted_alone():
    whole = pa.array(["one two", "three", None, "four five six"], pa.string())
    assert rules.measured(whole.slice(1, 3), blank()).field("n_words").to_pylist() == [1, 0, 3]


def junk(i):
    return " ".join(f"buy{j % 7}$$$" for j in range(i % 9, 40))


def prose(i):
    return " ".join(["the river runs past", "a quiet town near"][(i + j) % 2] for j in range(5 + i % 4))


def test_model_parts_junk_from_prose_it_has_not_seen():
    texts = [prose(i) if i % 2 else junk(i) for i in range(200)]
    rows = pa.table({"text": texts, "label": [float(i % 2) for i in range(200)], "weight": [1.0] * 200})
    model = rules.train(rows)
    p = rules.measured(pa.array(["a quiet river runs past the town", "cheap$$$ buy$$$ now$$$", "", None]), model).field("probability").to_pylist()
    assert p[0] > 0.8 and p[1] < 0.2
    assert p[2] == p[3] and 0 <= p[2] <= 1


def test_one_class_or_none_gives_its_share():
    none = pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.float64()), "weight": pa.array([], pa.float64())})
    assert rules.measured(pa.array(["x"]), rules.train(none)).field("probability").to_pylist() == [0.5]


def test_operator_keeps_rows_and_other_columns(spark, odd):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd + odd)], "doc_id bigint, text string, rules int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(8)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    out = rules.judge(docs, labels)
    assert out.columns == ["doc_id", "text", "rules"]
    got = out.select("doc_id", "rules.*").collect()
    assert len(got) == 2 * len(odd)
    by_id = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert all(by_id[i] == by_id[i + len(odd)] for i in range(len(odd)))
    assert rules.judge(docs.limit(0), labels.limit(0)).collect() == []
