"""Best-fit packing of documents into token sequences (operator 11).

Documents are cut into pieces of at most a sequence's length, and the pieces are placed in
rounds. A round takes all unplaced pieces of the greatest length and all gaps, both sorted
by size; each piece's place is the successor of its length among the gaps; pieces that want
the same gap are told apart by their rank, the first ones get it; the gaps are updated, and
the next round begins. Longer pieces first, the smallest gap that holds one: the result is
that of best-fit decreasing, piece by piece.

Pieces of one length are interchangeable, and so are sequences of one gap that were numbered
in a row. The rounds therefore work on runs, (length, how many) and (gap, first sequence,
how many), of which there are few, whatever the table holds: a run of gaps that is used up
leaves less than half its gap, and a round splits one run at most, so rounds over sequences
of ``limit`` tokens leave at most ``limit * (1 + 3 * log2(limit))`` runs of places. The rows
are met twice: to rank the pieces of each length, which needs one sum per task and length,
and to look each rank up among the runs of places. Neither moves the ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from flowlink.llm import arrays as A
from flowlink.llm.shared import stored
from flowlink.llm.tokens import CHUNK, encoder

PIECE = [
    StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("ids_crc32", LongType()), StructField("_task", IntegerType()), StructField("_nth", LongType()),
]
IDS = StructField("ids", ArrayType(IntegerType()))
RESULT = ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")
RANK_BITS = 42  # of a rank, in the one number that orders runs of places by length and rank


class Places(NamedTuple):
    """Runs of places, by length and first rank: rank r of a run is in sequence
    ``sequence + (r - rank) // per``, at ``offset + (r - rank) % per * length``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    per: np.ndarray


def best_fit(counts: Mapping[int, int], limit: int) -> Places:
    """The places of so many pieces of each length, by best fit, longest first."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # gaps there are, ascending
    used = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first = limit, used
                many = -(-left // (limit // length))
                used += many
            per = gap // length
            taken = min(left, many * per)
            full, rest = divmod(taken, per)
            runs.append((length, rank, first, limit - gap, per))
            leave(gap - per * length, first, full)
            leave(gap - rest * length, first + full, int(rest > 0))
            touched = full + (rest > 0)
            leave(gap, first + touched, many - touched)
            left, rank = left - taken, rank + taken
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return Places(*np.ascontiguousarray(table.T))


def cut(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, length) of the pieces of rows of so many ids; a row's first may be short."""
    many = np.maximum(1, -(-sizes // limit))
    row = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    first = sizes - (many - 1) * limit
    return row, number, np.where(number == 0, first[row], limit)


def pieces(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, end: int | None = 2, text: str = "text",
    keep: Sequence[str] | None = None, specials: bool = True, ids: bool = True,
) -> DataFrame:
    """The pieces of every text: piece, start, length, ids_crc32, ids beside the row's columns.

    ``ids`` are the library's without added special tokens, then ``end``; null and empty
    texts have that alone (without ``end``, none: a piece of length 0). ``start`` is the
    number of the row's ids before the piece, ``ids_crc32`` the checksum of the ids as
    little-endian 32-bit numbers. With ``specials`` the strings of special tokens in a text
    are those tokens, as is the library's default. Each row is encoded whole and by itself.
    Where only the plan of the sequences is wanted, ``ids=False`` leaves the ids out.
    ``_task`` and ``_nth`` tell the pieces of one length apart.
    """
    if not 0 < limit < 1 << 20:
        raise ValueError("a sequence has 1 to 2 ** 20 - 1 tokens")
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    made = {*RESULT, "_task", "_nth"}
    kept = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c not in made]
    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = StructType([*rows.select(*kept).schema.fields, *PIECE, *([IDS] if ids else [])])
    tail = np.array([] if end is None else [end], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, specials)
        task = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            for part in A.chunks(batch.column(len(kept)), CHUNK):
                found, bounds = coder.encode(part)
                found = np.insert(found, bounds[1:], tail[0]) if len(tail) else found
                row, number, length = cut(np.diff(bounds) + len(tail), limit)
                ends = np.cumsum(length)
                raw = memoryview(found.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip((ends - length).tolist(), ends.tolist())]
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(length), np.int64)
                run_of = length[order]
                nth[order] = seen[run_of] + np.arange(len(order)) - np.searchsorted(run_of, run_of)
                seen += np.bincount(length, minlength=limit + 1)
                begin = ends - length - (ends - length)[number == 0][row]
                columns = [batch.column(i).slice(part.first, part.rows).take(pa.array(row)) for i in range(len(kept))]
                columns += [
                    pa.array(number.astype(np.int32)), pa.array(begin), pa.array(length), pa.array(sums, pa.int64()),
                    pa.array(np.full(len(row), task, np.int32)), pa.array(nth),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def place(cut_up: DataFrame, limit: int = 1024) -> DataFrame:
    """Stored ``pieces`` with their ``sequence_id`` and ``offset``.

    What a consumer doesn't select is not read: without ``ids`` only numbers are shuffled.
    Driver: a count per length (at most ``limit``) and the runs of places (see above).
    """
    per_task = cut_up.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = best_fit({k: v for k, v in counts.items() if k}, limit)
    known = cut_up.sparkSession.sparkContext.broadcast(places)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def looked_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, nth = length.to_numpy(), rank.to_numpy()
        p = known.value
        if not len(p.length):
            return pa.array([None] * len(size), pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())]))
        run = np.searchsorted((p.length << RANK_BITS) + p.rank, (size << RANK_BITS) + nth, "right") - 1
        run = np.maximum(run, 0)
        turn, step = np.divmod(nth - p.rank[run], p.per[run])
        empty = size == 0
        return pa.StructArray.from_arrays(
            [pa.array(p.sequence[run] + turn, mask=empty), pa.array(p.offset[run] + step * size, mask=empty)], names=["sequence_id", "offset"]
        )

    ranked = cut_up.join(before, ["length", "_task"]).withColumn("_place", looked_up("length", F.col("_before") + F.col("_nth")))
    kept = [c for c in cut_up.columns if c not in ("_task", "_nth")]
    return ranked.select(*kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, end: int | None = 2, text: str = "text",
    keep: Sequence[str] | None = None, specials: bool = True, ids: bool = True,
) -> DataFrame:
    """Every document's pieces (see ``pieces``) and where each stands: sequence_id, offset.

    Only texts of more than ``limit`` ids are cut, into pieces of ``limit``, the first of
    which may be shorter. Sequences are filled without gaps from offset 0 and are as few as
    best-fit decreasing makes them. The row's columns but its text (or those in ``keep``)
    stand beside each of its pieces; those named as a column of the result are replaced. Rows are told
    apart by themselves, not by an id: null, equal and missing ids and repeated rows are
    documents like any other. An empty table gives an empty one. Pieces of length 0 (no
    ``end``, no text) belong to no sequence.

    The pieces are written to the shared folder once, with their ids (about twice the size
    of compressed text) unless ``ids`` is false; a lost executor's part is encoded again.
    """
    return place(stored(pieces(docs, tokenizer_path, limit, end, text, keep, specials, ids), "pieces"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's ids in order, at most its limit of them."""
    held = packed.filter(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("_parts"))
    return held.select("sequence_id", F.flatten(F.transform(F.array_sort("_parts"), lambda p: p["ids"])).alias("ids"))
