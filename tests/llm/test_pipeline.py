"""The pipeline's stages against what each operator's plain version says, one after the other."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from flowlink.llm import labelled, quality
from tests.llm import test_decontaminate, test_jaccard, test_lines
from tests.llm.test_models import junk, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, near copies, shared lines and a benchmark passage."""
    draw = random.Random(11)
    texts = [junk(draw) if i % 5 == 0 else test_lines.sentence(draw, 25) + "\n" + prose(draw) for i in range(60)]
    texts += [texts[1], texts[2] + " more", texts[3].replace("a", "a", 1), None, "", "\n"]
    passage = test_lines.sentence(draw, 30)
    texts += [test_lines.sentence(draw, 40) + "\n" + passage, test_lines.sentence(draw, 2000) + "\n" + passage[:150]]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, passage)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: r[0])


def test_each_stage_keeps_what_its_plain_version_keeps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = rows(docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(labelled.sample(docs, labels, "quality", quality.PER_CLASS))
    score = quality.scored(pa.array([t for _, t in given], pa.string()), model).to_numpy()
    kept = [r for r, s in zip(given, score) if s >= quality.THRESHOLD]
    by_name = dict(corpus_pipeline.STAGES)
    docs = by_name["quality_classifier"](spark, docs, folder)
    assert docs.columns == COLUMNS and rows(docs) == kept
    assert {r[0] for r in given} - {r[0] for r in kept} <= {i for i in range(60) if i % 5 == 0} | {63, 64, 65}

    texts, _ = test_lines.brute(kept)
    had = dict(kept)
    kept = [(i, t) for i, t in sorted(texts.items()) if t == had[i] or t.strip()]
    docs = by_name["line_dedup"](spark, docs, folder)
    assert docs.columns == COLUMNS and rows(docs) == kept
    assert 60 not in dict(kept)

    lowest = test_jaccard.brute(kept, 5, 80)
    one = {i for i, _, c in lowest if i == c}
    kept = [r for r in kept if r[0] in one]
    docs = by_name["ngram_jaccard"](spark, docs, folder)
    assert docs.columns == COLUMNS and rows(docs) == kept

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {d: (n, hit) for d, n, hit, _ in test_decontaminate.brute(kept, items, 13)}
    kept = [(d, t) for d, t in kept if not (found[d][1] and 20 * found[d][1] >= found[d][0])]
    docs = by_name["decontamination"](spark, docs, folder)
    assert docs.columns == COLUMNS and rows(docs) == kept
    assert 66 not in dict(kept) and 67 in dict(kept)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = by_name["sentencepiece"](spark, docs, folder)
    assert out.columns == [*COLUMNS, "ids", "starts", "ends"]
    assert {r["doc_id"]: list(r["ids"]) for r in out.collect()} == {d: library.encode(t or "", add_eos=True) for d, t in kept}


def test_run_gives_the_last_stages_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_every_operator_and_the_pipeline_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert {"op4_ngram_jaccard", "op10_decontamination"} <= set(contract.oracle_sql())
