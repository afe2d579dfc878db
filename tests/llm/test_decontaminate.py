"""Windows of benchmark items against a search word by word."""

import random
import re

import pytest

from flowlink.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, held = set(), set()
        for item, told in items:
            v = words(told)
            for j in range(max(1, len(v) - size + 1)) if v else []:
                window = v[j : j + size]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit |= set(range(i, i + len(window)))
                        held.add(str(item))
        out.append((doc, len(w), len(hit), tuple(sorted(held))))
    return sorted(out, key=repr)


def result(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed,size,block", [(1, 3, 1000), (2, 4, 3), (3, 2, 1000), (4, 13, 1000)])
def test_hits_match_a_plain_search(spark, seed, size, block):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "c1", "é", "Éa", "the", "ΑΣ", "x"]

    def text(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "-", "\x00", "  "]) for _ in range(n))

    items = [(i, text(draw.randint(0, 2 * size))) for i in range(12)] + [(50, None), (51, "...")]
    docs = [(i, text(draw.randint(0, 40)) + draw.choice([t or "" for _, t in items]) + text(5)) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "?!"), (None, items[3][1])]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"), window=size, block=block,
    )
    assert result(found) == brute(docs, items, size)


def test_equal_items_repeated_rows_and_other_columns(spark, odd):
    passage = " ".join(f"Word{i}" for i in range(20))
    docs = [(i, t, 1) for i, t in enumerate(odd)] + [(70, "x. " + passage + " y", 1)] * 3 + [(71, passage.replace("7", "8"), 1)]
    items = [(1, passage, 0), (2, passage.upper(), 0), (10, passage, 0)]
    left = spark.createDataFrame(docs, "doc_id bigint, text string, n_hit int")
    right = spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    got = result(decontaminate.contamination(left, right))
    assert got == brute([(i, t) for i, t, _ in docs[: len(odd) + 1]] + [(71, docs[-1][1])], [(i, t) for i, t, _ in items], 13)
    kept = decontaminate.remove_contaminated(left, right)
    assert kept.columns == left.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(len(odd)), 71]
    assert decontaminate.remove_contaminated(left, right.limit(0)).count() == len(docs)
    assert decontaminate.contamination(left.limit(0), right).collect() == []


def test_one_word_in_twenty_is_the_rule(spark):
    passage = " ".join(f"b{i}" for i in range(13))
    docs = [(1, passage + " z" * 247), (2, passage + " z" * 248)]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    )
    assert {r["doc_id"]: r["bad"] for r in found.withColumn("bad", decontaminate.contaminated()).collect()} == {1: True, 2: False}


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
