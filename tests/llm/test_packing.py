"""Packing against the library's ids and best-fit decreasing one piece at a time."""

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlink.llm import arrays, packing, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def mixed():
    parts = ["a", "été", "don't", " ", "  ", "\n", "\t", " ", "　", "\u0085", "x,", "é", "😀", "'s", "12", "ÿ", "߿", "ﬁ", "<|endoftext|>", "\x1c", "́"]
    draw = random.Random(5)
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(400)]


def test_ids_are_those_of_whole_texts(library):
    texts = [None, *mixed()]
    coder, got = tokens.Encoder(FILE, True), []
    for part in arrays.chunks(pa.array(texts), 300):
        ids, bounds = coder.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [ids_of(library, t) for t in texts]


def one_by_one(lengths, limit):
    """How many sequences best-fit decreasing opens."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else limit
        opened += at == len(gaps) and gap == limit
        insort(gaps, gap - n)
    return opened


@pytest.mark.parametrize("seed", range(30))
def test_places_are_those_of_best_fit_decreasing(seed):
    draw = random.Random(seed)
    limit = draw.choice([7, 16, 100, 1024])
    lengths = [min(limit, 1 + int(limit * draw.random() ** draw.choice([1, 3]))) for _ in range(draw.randint(0, 600))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    places = packing.best_fit(counts, limit)
    filled, used = defaultdict(int), set()
    for i in range(len(places.length)):
        length = int(places.length[i])
        last = counts[length] if i + 1 == len(places.length) or places.length[i + 1] != length else int(places.rank[i + 1])
        for r in range(last - int(places.rank[i])):
            turn, step = divmod(r, int(places.per[i]))
            where = (int(places.sequence[i]) + turn, int(places.offset[i]) + step * length)
            assert where not in used
            used.add(where)
            filled[where[0]] += length
    assert len(used) == len(lengths) and sum(filled.values()) == sum(lengths)
    assert all(n <= limit for n in filled.values())
    # However equal gaps are told apart, the sizes of the gaps are the same after every piece.
    assert len(filled) == one_by_one(lengths, limit)
    assert len(places.length) <= limit * (1 + 3 * limit.bit_length())


def checked(rows, library, docs, limit):
    got = [r.asDict() for r in packing.pack(docs, FILE, limit).collect()]
    by_row, held = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r["doc_id"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
        assert r["length"] == len(r["ids"]) <= limit
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, text, *_ in rows:
        parts = sorted(by_row[i], key=lambda r: r["piece"])
        whole = [*ids_of(library, text), 2]
        assert [t for p in parts for t in p["ids"]] == whole
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts[:-1]]]).tolist()
        assert len(parts) == max(1, -(-len(whole) // limit)) and all(p["length"] == limit for p in parts[1:])
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda p: p[0]):
            assert offset == at
            at += length
        assert at <= limit
    assert len(held) == one_by_one([r["length"] for r in got], limit)
    return got, held


@pytest.mark.parametrize("limit", [5, 64, 1024])
def test_pieces_fill_sequences_without_gaps(spark, odd, library, limit):
    draw = random.Random(limit)
    texts = odd + mixed()[:60] + [" ".join(draw.choice(["the", "packing", "océan"]) for _ in range(draw.randint(1, 300))) for _ in range(60)] + ["copy of one"] * 90
    rows = [(i, t, "kept", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string, length int").repartition(7)
    got, held = checked(rows, library, docs, limit)
    whole = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(packing.pack(docs, FILE, limit)).collect()}
    assert sorted(map(len, whole.values())) == sorted(sum(n for _, n, _ in p) for p in held.values())
    assert sum(map(len, whole.values())) == sum(r["length"] for r in got)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(docs, FILE, 8).collect()
    assert sorted(r["length"] for r in got) == [1, 1, 4, 4]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert packing.pack(docs.limit(0), FILE, 8).collect() == []
    bare = packing.pack(docs, FILE, 8, end=None).collect()
    assert sorted(r["length"] for r in bare) == [0, 0, 3, 3]
    assert all((r["sequence_id"] is None) == (r["length"] == 0) for r in bare)
