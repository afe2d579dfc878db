"""Byte-level BPE ids of whole batches of texts, by the ``tokenizers`` library.

Such a tokenizer cuts a text by its pattern first and merges inside the cuts only. There is
always a cut before a single space that stands between two characters that aren't white
space, and between a letter or digit and a point, a comma or the like. The stretches between
such places can be encoded apart: equal ones are encoded once per batch and remembered, a
bounded number of them, and the ids are those of the whole text. Tokenizers are given, never
trained.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles

from flowlink.llm import arrays as A

CHUNK = 1 << 22  # bytes of text encoded at a time
REMEMBERED = 350_000  # stretches a worker remembers
SHORT = 64  # characters of a stretch worth remembering

_GRAPH = np.zeros(256, bool)  # ASCII characters that aren't white space
_GRAPH[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)  # first bytes of two-byte characters, none of which is white space
_LEAD[0xC3:0xE0] = True
_WORD = np.zeros(256, bool)  # ASCII letters and digits
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_STOP = np.zeros(256, bool)  # what never goes on with them; an apostrophe can
_STOP[[33, 40, 41, 44, 46, 58, 59, 63]] = True  # ! ( ) , . : ; ?


def stretches(text: A.Text) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin, and the number of those before each row bound."""
    data, bounds = text.data, text.bounds
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    before = data[at - 1]
    after = data[at + 1]
    calm = (_GRAPH[before] | ((before >= 0x80) & _LEAD[data[np.maximum(at - 2, 0)]])) & (_GRAPH[after] | _LEAD[after])
    stops = np.flatnonzero(_STOP[data[1:]] & _WORD[data[:-1]]) + 1
    begins = np.sort(np.concatenate([at[calm], stops, bounds[:-1][np.diff(bounds) > 0]]), kind="stable")
    begins = begins[np.diff(begins, prepend=-1) > 0]
    return begins, np.searchsorted(begins, bounds)


class Encoder:
    def __init__(self, file: str, specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not specials
        self._forget()

    def _forget(self) -> None:
        """Known stretches by number, and the ids of number i from ``bounds[i]`` to ``bounds[i + 1]``."""
        self.known: dict[str, int] = {}
        self.pool, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _looked_up(self, values: list[str]) -> np.ndarray:
        """The numbers of stretches; new ones are encoded and stay until the next call at least."""
        if len(self.bounds) > REMEMBERED:
            self._forget()
        known = self.known
        numbers = np.fromiter(map(known.get, values, repeat(-1)), np.int64, len(values))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = [values[i] for i in missing.tolist()]
            # The fast one leaves out the places of tokens in the text.
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            first = len(self.bounds) - 1
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            self.pool = np.concatenate([self.pool, flat])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            numbers[missing] = np.arange(first, first + len(new))
            known.update((v, i) for i, v in enumerate(new, first) if len(v) <= SHORT)
        return numbers

    def encode(self, text: A.Text) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and where each row's begin and end."""
        begins, per_row = stretches(text)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(text.rows + 1, np.int64)
        offsets = np.append(begins, len(text.data)).astype(np.int64)
        whole = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text.data)))
        coded = whole.dictionary_encode()
        which = self._looked_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first = self.bounds[which]
        many = self.bounds[which + 1] - first
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat(first - ends[:-1], many) + np.arange(ends[-1])]
        return ids, ends[per_row]


@lru_cache(maxsize=2)
def encoder(name: str, specials: bool) -> Encoder:
    return Encoder(SparkFiles.get(name), specials)
