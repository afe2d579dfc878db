"""The trained models on rows they have not seen."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowlink.llm import labelled, quality, toxicity

INSULTS = ["idiot", "moron", "worthless", "disgusting", "pathetic"]
WORDS = ["river", "house", "people", "walk", "green", "quiet", "morning", "letter", "idea", "modern", "worth", "pathway", "gust"]


def sentence(draw, n):
    return [draw.choice(WORDS) + draw.choice(["", "", "s", "ing"]) for _ in range(n)]


def toxic(draw, n):
    words = sentence(draw, n)
    for _ in range(2):
        words.insert(draw.randrange(len(words) + 1), draw.choice(INSULTS))
    return words


def rows_of(texts, labels):
    return pa.table({"text": texts, "label": [float(x) for x in labels], "weight": [1.0] * len(labels)})


@pytest.fixture(scope="module")
def toxic_model():
    draw = random.Random(1)
    labels = [i % 2 for i in range(400)]
    texts = [" ".join(toxic(draw, draw.randint(5, 120)) if y else sentence(draw, draw.randint(5, 120))) for y in labels]
    return toxicity.train(rows_of(texts, labels))


def scores(module, texts, model):
    return module.scored(pa.array(texts, pa.string()), model).to_numpy()


def test_toxic_texts_of_any_length_are_told(toxic_model):
    draw = random.Random(2)
    bad = [" ".join(toxic(draw, n)) for n in (3, 20, 100, 1500) for _ in range(20)]
    good = [" ".join(sentence(draw, n)) for n in (3, 20, 100, 1500) for _ in range(20)]
    assert (scores(toxicity, bad, toxic_model) >= 0.5).mean() > 0.95
    assert (scores(toxicity, good, toxic_model) < 0.5).mean() > 0.95


def test_unseen_misspellings_share_ngrams(toxic_model):
    told = ["what an idiott you are", "such a MORONS", "worthlesss people", "how disgustingg it is"]
    plain = ["what a house you have", "such a river", "green people", "how quiet it is"]
    assert scores(toxicity, told, toxic_model).min() > scores(toxicity, plain, toxic_model).max()


def test_short_and_wordless_texts_have_a_score(toxic_model, odd):
    got = scores(toxicity, odd, toxic_model)
    assert len(got) == len(odd) and ((got >= 0) & (got <= 1)).all()
    assert got[0] == got[1] == got[2]


def test_grams_of_a_word_match_plain_python():
    text = next(iter(toxicity.A.chunks(pa.array(["Ab cdefgh i"]))))
    spans = toxicity.A.words(text, toxicity.PARTS)
    word, bucket = toxicity.grams(text.data, spans.starts, spans.ends)
    marked = ["<ab>", "<cdefgh>", "<i>"]
    want = [sum(max(0, len(m) - n + 1) for n in toxicity.SIZES) for m in marked]
    assert np.bincount(word).tolist() == want and (bucket < toxicity.BUCKETS).all()
    again = next(iter(toxicity.A.chunks(pa.array(["AB"]))))
    other = toxicity.A.words(again, toxicity.PARTS)
    assert sorted(toxicity.grams(again.data, other.starts, other.ends)[1]) == sorted(bucket[word == 0])


def prose(draw):
    return "\n".join(" ".join(sentence(draw, draw.randint(6, 14))).capitalize() + "." for _ in range(draw.randint(1, 6)))


def junk(draw):
    kind = draw.randrange(3)
    if kind == 0:
        return " ".join(w + draw.choice(["$$$", "***"]) for w in sentence(draw, 30))
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in sentence(draw, 30))
    return "\n".join([" ".join(sentence(draw, 4))] * 12)


def test_quality_is_told_on_unseen_rows():
    draw = random.Random(3)
    labels = [i % 2 for i in range(600)]
    model = quality.fit(rows_of([prose(draw) if y else junk(draw) for y in labels], labels))
    assert scores(quality, [prose(draw) for _ in range(100)], model).min() > 0.3
    assert scores(quality, [junk(draw) for _ in range(100)], model).max() < 0.3


def test_pairs_of_features_are_learned():
    draw = np.random.default_rng(1)
    x = draw.random((2000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, np.ones(2000))
    assert (0, 1) in model.pairs
    assert ((quality.predict(model, x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_features_of_odd_texts_are_finite(odd):
    whole = np.concatenate([quality.features(t) for t in quality.A.chunks(pa.array(odd, pa.string()))])
    assert whole.shape == (len(odd), len(quality.NAMES)) and np.isfinite(whole).all()
    assert (whole[0] == whole[1]).all()


def test_one_class_or_none_gives_its_share():
    none = rows_of(pa.array([], pa.string()), [])
    assert scores(quality, ["x", None], quality.fit(none)).tolist() == [0.5, 0.5]
    assert scores(toxicity, ["x", None], toxicity.train(none)).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("score,label,caught,wrong", [(toxicity, "toxic", 0.6, 0.08), (quality, "quality", 0.9, 0.1)])
def test_held_out_rows_of_a_small_table_are_told(spark, score, label, caught, wrong):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    run = score.score_toxicity if score is toxicity else score.score_quality
    held = run(docs.select("doc_id", "text"), labels).join(labels, "doc_id").filter(labelled.held_out("doc_id", 5, 0))
    rows = [(r[label], r["score"] >= score.THRESHOLD) for r in held.select(label, "score").collect()]
    assert sum(y and p for y, p in rows) >= caught * sum(y for y, _ in rows)
    assert sum(p and not y for y, p in rows) <= wrong * sum(not y for y, _ in rows) + 1


def test_the_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(900, None)], "doc_id bigint, text string")
    labels = [(i, int(i % 4 > 0), 0) for i in range(300)] + [(3, None, 0), (None, 1, 0), (4, 1, 1), (900, 1, 1), (7, 5, 0)]
    got = labelled.sample(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), "quality", 20)
    ids = [int(t[1:]) for t in got["text"].to_pylist()]
    assert len(ids) == len(set(ids)) == 40
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert got["label"].to_pylist() == [float(i % 4 > 0 or i == 4) for i in ids]
    again = labelled.sample(docs.repartition(7), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), "quality", 20)
    assert again == got


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_operators_keep_rows_and_other_columns(spark, odd, score):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd + odd)], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(odd))], "doc_id bigint, quality int, toxic int")
    out = score(docs, labels)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert len(got) == 2 * len(odd) and all(0 <= s <= 1 for s in got.values())
    assert all(got[i] == got[i + len(odd)] for i in range(len(odd)))
    assert score(docs.limit(0), labels.limit(0)).collect() == []
