"""SentencePiece encoding that keeps offsets, and decoding (operator 1).

The text is normalised here by the model's own compiled character map: at each byte the
longest prefix found in the map's double-array trie is replaced, and every normalised byte
remembers the source byte it came from. The library segments the text; the length of each
piece in normalised bytes then cuts that record into spans of source bytes. Tokenizers are
given, never trained.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from flowlink.llm import arrays as A

SPACE = "▁".encode()  # what stands for a space in pieces

NUMBERS = ArrayType(IntegerType())
RESULT = StructType(
    [StructField(n, NUMBERS) for n in ("ids", "starts", "ends")] + [StructField("decoded", StringType())]
)


class Rules(NamedTuple):
    """What a model file says about normalising."""

    units: np.ndarray
    strings: bytes
    dummy_prefix: bool
    trim: bool
    escape: bool


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


def read_rules(model: bytes) -> Rules:
    """Field 3 of a model file: its normaliser. Numbers and defaults are the file format's."""
    chart, dummy, trim, escape = b"", True, True, True
    for number, value in _fields(model):
        if number == 3:
            for n, v in _fields(value):
                if n == 2:
                    chart = v
                elif n == 3:
                    dummy = bool(v)
                elif n == 4:
                    trim = bool(v)
                elif n == 5:
                    escape = bool(v)
    size = int.from_bytes(chart[:4], "little") if chart else 0
    return Rules(np.frombuffer(chart[4 : 4 + size], np.uint32), chart[4 + size :], dummy, trim, escape)


def longest(rules: Rules, data: bytes, at: int) -> tuple[int, bytes]:
    """(bytes taken, what stands for them) of the longest mapped prefix at ``at``.

    Without one, the character there stands for itself.
    """
    units = rules.units
    best = None
    if len(units):
        node = 0
        unit = int(units[0])
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if (unit & 0x800000FF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                best = (i + 1 - at, int(units[node]) & 0x7FFFFFFF)
    if best:
        taken, place = best
        return taken, rules.strings[place : rules.strings.index(b"\0", place)]
    first = data[at]
    taken = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    return min(taken, len(data) - at), data[at : at + taken]


def normalise(rules: Rules, data: bytes) -> tuple[bytes, np.ndarray]:
    """The normalised text, and per normalised byte the source byte it came from.

    The record has one entry more: where the last piece ends.
    """
    if not len(rules.units) and not rules.trim:
        return _identity(rules, data)
    out, source = bytearray(), []
    space = SPACE if rules.escape else b" "
    parts, at = [], 0
    while at < len(data):
        taken, said = longest(rules, data, at)
        parts.append((at, said))
        at += taken
    end = len(data)
    if rules.trim:
        while parts and not parts[0][1].strip(b" "):
            parts.pop(0)
        while parts and not parts[-1][1].strip(b" "):
            end = parts.pop()[0]
    if not parts:
        return b"", np.zeros(1, np.int64)
    if rules.dummy_prefix:
        out += space
        source += [parts[0][0]] * len(space)
    before = rules.trim
    for place, said in parts:
        if before:
            said = said.lstrip(b" ")
        if not said:
            continue
        told = said.replace(b" ", space)
        out += told
        source += [place] * len(told)
        before = rules.trim and said.endswith(b" ")
    while rules.trim and out.endswith(space):
        end = source[-1]
        del out[-len(space) :], source[-len(space) :]
    return bytes(out), np.array([*source, end], np.int64)


def _identity(rules: Rules, data: bytes) -> tuple[bytes, np.ndarray]:
    """``normalise`` of a model without a map: only spaces change."""
    if not data:
        return b"", np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    if rules.escape:
        width = np.where(raw == 32, len(SPACE), 1)
        source = np.repeat(np.arange(len(raw)), width)
        data = data.replace(b" ", SPACE)
    else:
        source = np.arange(len(raw))
    if rules.dummy_prefix:
        lead = SPACE if rules.escape else b" "
        data, source = lead + data, np.concatenate([np.zeros(len(lead), np.int64), source])
    return data, np.append(source, len(raw))


def piece_sizes(processor: sentencepiece.SentencePieceProcessor) -> np.ndarray:
    """Normalised bytes per id: one for a byte piece, none for control pieces, -1 if unknown."""
    sizes = np.zeros(processor.get_piece_size(), np.int64)
    for i in range(len(sizes)):
        if processor.is_byte(i):
            sizes[i] = 1
        elif processor.is_unknown(i):
            sizes[i] = -1
        elif not processor.is_control(i):
            sizes[i] = len(processor.id_to_piece(i).encode())
    return sizes


class Encoder:
    """A model file, ready to encode, to project pieces onto the source, and to decode."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rules = read_rules(model)
        self.sizes = piece_sizes(self.processor)
        self.end = self.processor.eos_id()

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte ranges of the pieces.

        A piece begins where its first normalised byte came from and ends where the next
        piece's does; pieces inside one source character, byte pieces included, share it.
        """
        normal, source = normalise(self.rules, text.encode())
        sizes = self.sizes[ids]
        if (sizes < 0).any():  # unknown characters: their length is the text's, not the piece's
            surfaces = self.processor.encode(text, out_type="immutable_proto").pieces
            sizes = np.array([len(p.piece.encode()) if n < 0 else n for p, n in zip(surfaces, sizes)], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        if at[-1] != len(normal):
            raise ValueError(f"pieces cover {at[-1]} bytes of {len(normal)} normalised ones")
        return source[at[:-1]], np.maximum(source[at[1:]], source[at[:-1]])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """Ids with the end id, spans (the end id's is empty, at the end), and the text decoded."""
        plain = self.processor.encode(text)
        ids = np.array([*plain, self.end], np.int32)
        starts, ends = self.spans(text, ids[:-1])
        size = len(text.encode())
        return ids, np.append(starts, size), np.append(ends, size), self.processor.decode(plain)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as f:
        return Encoder(f.read())


def encoded(texts: pa.Array, model: Encoder) -> pa.StructArray:
    """The result struct of every text; null is empty."""
    ids, starts, ends, decoded, bounds = [], [], [], [], [0]
    for value in texts:
        got = model.encode(value.as_py() or "")
        for column, part in zip((ids, starts, ends), got):
            column.append(part)
        decoded.append(got[3])
        bounds.append(bounds[-1] + len(got[0]))

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))

    return pa.StructArray.from_arrays(
        [lists(ids), lists(starts), lists(ends), pa.array(decoded, pa.string())], names=["ids", "starts", "ends", "decoded"]
    )


def encode(
    docs: DataFrame, model_path: str, text: str = "text", into: str = "pieces", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with a struct column ``into``: ids, starts, ends, decoded.

    ``ids`` are those of the library with the end id only and without sampling; ``starts``
    and ``ends`` are byte offsets in the UTF-8 source; ``decoded`` is the library's decoding
    of the ids. Null and empty texts have the end id alone. All other columns stay (or those
    named in ``keep``); one named as ``into`` is replaced. An empty table stays empty. Each
    row is encoded by itself: no shuffle, and a lost executor's rows are simply encoded
    again. Results leave in batches of about ``CHUNK`` bytes of text, which bounds memory.

    The model file is read on the driver and shipped by Spark to every executor.
    """
    docs.sparkSession.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = StructType([*rows.select(*kept).schema.fields, StructField(into, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(name)
        for batch in batches:
            texts = batch.column(len(kept))
            for part in A.chunks(texts):
                found = encoded(texts.slice(part.first, part.rows), model)
                columns = [batch.column(i).slice(part.first, part.rows) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, found], names=[*kept, into])

    return rows.mapInArrow(run, schema)
