"""SentencePiece spans against the library's own."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from flowlink.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as f:
        return pieces.Encoder(f.read())


def texts():
    chars = "ab  é😀\n\t▁<s></s>０ﬁ​́x."
    draw = random.Random(3)
    return ["", " ", "  two  spaces ", "hello\nworld", "▁▁", "<s> </s> <unk> <0x41>"] + [
        "".join(draw.choice(chars) for _ in range(draw.randint(1, 60))) for _ in range(200)
    ]


def test_ids_and_decoded_text_are_the_librarys(library, encoder):
    for text in texts():
        ids, starts, ends, decoded = encoder.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert decoded == library.decode(ids.tolist())
        assert len(ids) == len(starts) == len(ends)


def test_spans_cover_the_text_and_hold_the_pieces(library, encoder):
    for text in texts():
        raw = text.encode()
        ids, starts, ends, _ = encoder.encode(text)
        assert (np.diff(starts) >= 0).all() and starts[-1] == ends[-1] == len(raw)
        covered = set()
        for i, a, b in zip(ids[:-1].tolist(), starts, ends):
            covered |= set(range(a, b))
            if not library.is_byte(i) and "▁" not in text:
                assert raw[a:b].decode().replace(" ", "▁").lstrip("▁") == library.id_to_piece(i).lstrip("▁")
        assert covered == set(range(len(raw)))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_normalising_follows_a_compiled_map(rule):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, remove_extra_whitespaces=True, add_dummy_prefix=True, escape_whitespaces=True
    )
    rules = pieces.read_rules(library.serialized_model_proto())
    assert len(rules.units)
    for text in texts() + ["ﬁne ²Å ①  ｱ", "ÀÉ Straße", "  lead", "tail  "]:
        normal, source = pieces.normalise(rules, text.encode())
        assert normal.decode() == library.normalize(text), text
        assert len(source) == len(normal) + 1
        assert (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_all_rows_and_columns_come_back(spark, odd, library):
    rows = [(i, t, "kept") for i, t in enumerate(odd + odd)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pieces string")
    out = {r["doc_id"]: r["pieces"] for r in pieces.encode(docs, MODEL).collect()}
    assert len(out) == len(rows)
    for i, text, _ in rows:
        assert list(out[i]["ids"]) == library.encode(text or "", add_eos=True)
        assert out[i]["decoded"] == library.decode(list(out[i]["ids"]))
    assert pieces.encode(docs.limit(0), MODEL).collect() == []
