"""Secret scans (operator 5): fixed patterns, and novelty under a primed compressor.

A candidate is a long run of token characters with digits in a sensitive context, cut at its
inner ``=`` signs, so an unspaced ``NAME=value`` has its name as context. It is
compressed by zstandard primed with the text around it and a dictionary of identifiers:
what repeats its surroundings or is made of known names costs few bytes, a random key as many
as any random characters of its alphabet. Candidates that cost nearly that are reported.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.llm import arrays as A

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# A word that makes what follows it sensitive.
SENSITIVE = re.compile(
    r"(?ai:pass|pwd|secret|token|api|key|auth|bearer|credential|private|session|signature|cookie|access)"
)
NEAR = 48  # code points before a candidate that count as its context
AROUND = 2048  # code points on each side that prime the compressor
SHORTEST = 16
NOVELTY = 0.8  # marginal bytes, by those of random characters: about 1 for random keys, 0.7 for known names run together
DRAWS = 4  # random strings that tell what a length and alphabet cost

IDENTIFIERS = " ".join(
    "abstract access account address api_key application argument array assert async attribute authorization await "
    "base64 bearer boolean buffer callback certificate class client config connection const content context cookie "
    "count credential database default delete description dictionary document domain element encoding endpoint "
    "environment error exception export extends false filename function handler header hostname identifier import "
    "index instance integer interface iterator javascript json language length library license localhost message "
    "method module namespace number object option package parameter password path pattern permission platform "
    "port private process property protocol public python query reference register request require response "
    "result return schema secret select server service session signature source static status string struct "
    "subprocess table template thread timeout timestamp token transaction true type undefined update username "
    "utf-8 value variable version vector warning website window http:// https:// www. .com .org .net .html .json "
    "0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 ffffffff xxxxxxxx"
    .split()
).encode()

TOKEN = np.zeros(256, bool)
TOKEN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
HEXES = np.zeros(256, bool)
HEXES[48:58] = HEXES[97:103] = True

# What keys are written in, smallest first.
ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-",
]

RESULT = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches, leftmost and non-overlapping per kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def marginal(told: bytes, primer: bytes) -> int:
    """Compressed bytes of ``told`` beyond those of nothing, given ``primer``."""
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return max(0, len(press.compress(told)) - len(press.compress(b"")))


@lru_cache(maxsize=4096)
def random_cost(length: int, alphabet: str) -> float:
    """What as many random characters of that alphabet cost, on average: zstandard packs long ones closer."""
    draw = np.random.default_rng(length)
    letters = np.frombuffer(alphabet.encode(), np.uint8)
    return sum(marginal(letters[draw.integers(0, len(letters), length)].tobytes(), IDENTIFIERS) for _ in range(DRAWS)) / DRAWS


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end], given what surrounds it, by those of random characters of its alphabet.

    Its own copies are cut out of the surroundings: a key is no less a key for being said twice.
    """
    told = text[start:end]
    around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).replace(told, "\n")
    used = set(told.rstrip("="))
    alphabet = next(a for a in ALPHABETS if used.issubset(a))
    return marginal(told.encode(), IDENTIFIERS + b" " + around.encode()) / random_cost(len(told), alphabet)


def novel_spans(text: str, candidates: list[tuple[int, int]], least: float = NOVELTY) -> list[tuple[str, int, int, float]]:
    """Candidates in a sensitive context that stay incompressible."""
    out = []
    for start, end in candidates:
        if SENSITIVE.search(text, max(0, start - NEAR), start):
            score = novelty(text, start, end)
            if score >= least:
                out.append(("novel", start, end, score))
    return out


PART = re.compile(r"[^=]+(?:=+\Z)?")


def values(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a run between its inner ``=`` signs that can be keys; padding at its end stays."""
    out = []
    for m in PART.finditer(text[start:end]):
        told = m[0]
        if len(told) >= SHORTEST and re.search("[0-9]", told) and re.search("[A-Za-z]", told):
            out.append((start + m.start(), start + m.end()))
    return out


def _runs(mask: np.ndarray, text: A.Text, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of at least ``least`` true bytes within a row."""
    spans = A.words(text, ~mask)
    long = spans.ends - spans.starts >= least
    return spans.starts[long], spans.ends[long]


def scan(texts: pa.Array, least: float = NOVELTY) -> list[list[tuple[str, int, int, float | None]]]:
    """The spans of every text, in order; null has none.

    Byte classes find the rows that can hold anything at all; only those are looked at one
    by one. The keyword search ignores the case of A-Z only, as the pattern does.
    """
    out: list[list[tuple[str, int, int, float | None]]] = []
    for text in A.chunks(texts):
        starts, ends = _runs(TOKEN, text, SHORTEST)
        digits, letters = np.cumsum(DIGIT[text.data]), np.cumsum(LETTER[text.data])
        mixed = (digits[ends - 1] - digits[starts] + DIGIT[text.data[starts]] > 0) & (
            letters[ends - 1] - letters[starts] + LETTER[text.data[starts]] > 0
        )
        starts, ends = starts[mixed], ends[mixed]
        row = np.searchsorted(text.bounds, starts, "right") - 1
        hexes = np.searchsorted(text.bounds, _runs(HEXES, text, 24)[0], "right") - 1
        maybe = set(row.tolist()) | set(hexes.tolist())
        raw = text.data.tobytes()
        for m in KEYWORD.finditer(raw):
            maybe.add(int(np.searchsorted(text.bounds, m.start(), "right")) - 1)
        spans = [[] for _ in range(text.rows)]
        for i in maybe:
            lo, hi = int(text.bounds[i]), int(text.bounds[i + 1])
            piece = raw[lo:hi].decode()
            here = [
                part for a, b in zip(starts[row == i].tolist(), ends[row == i].tolist())
                for part in values(piece, len(raw[lo:a].decode()), len(raw[lo:b].decode()))
            ]
            found = [(*s, None) for s in base_spans(piece)] + novel_spans(piece, here, least)
            spans[i] = sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))
        out += spans
    return out


# Where an assignment or an access key can be, in bytes: a superset of what the patterns match.
KEYWORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA")


def spans_array(found: list[list[tuple[str, int, int, float | None]]]) -> pa.ListArray:
    flat = [s for spans in found for s in spans]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [
            pa.array([s[0] for s in flat], pa.string()),
            pa.array([s[1] for s in flat], pa.int64()),
            pa.array([s[2] for s in flat], pa.int64()),
            pa.array([s[3] for s in flat], pa.float64()),
        ],
        names=["kind", "start", "end", "novelty"],
    )
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", least: float = NOVELTY) -> DataFrame:
    """``docs`` with an array column ``into`` of (kind, start, end, novelty), by place.

    Offsets are code points, ends exclusive; ``novelty`` is null for pattern matches. Null
    and empty texts have none. All other columns stay; one named as ``into`` is replaced.
    An empty table stays empty. Each row is scanned by itself, whole: no shuffle.
    """

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        return spans_array(scan(texts, least))

    return docs.withColumn(into, run(F.col(text)))
