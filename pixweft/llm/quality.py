"""Quality rules: word statistics and compression bands.

Base: fewer than MIN_WORDS words, or over half of the words in 3-word windows that occur
twice or more, fails. Bands: the zstandard ratio (compressed bytes over bytes) of the whole
text and of each fixed chunk of CHUNK bytes must lie between limits that depend on the length: repetitive
text falls below, random text rises above. A text fails if its whole ratio is outside its
band, or if chunks with at least BAD_SHARE of its bytes are outside theirs.
Padding with symbols lowers the ratio of text that is too random to be prose into the band of prose. So the ratio of the text without its symbols is taken as well; where it is higher than the whole's by more than
a gain that depends on the length, too, the text fails. Prose, manuals, licences and program code gain nothing by that, or less than half as much.

A null text counts as an empty one: no words, so it fails. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textkernel as K
from .shared import column, judged, texts

MIN_WORDS, REPEAT_PERCENT, LEVEL, CHUNK, BAD_SHARE = 50, 50, 3, 4096, 0.34
#: (bytes from, lowest ratio, highest ratio); between two rows the limits run linearly in log2 of the bytes.
#: The lower limits leave room for manuals and articles, which repeat their terms: their ratio falls to 0.35 at 20 KB and 0.25 at 500 KB.
#: Chunks of CHUNK bytes inside a longer text have the wider CHUNK_BAND.
#: From 2 MB, the window of level 3, the ratio of clean text stays as it is.
BANDS = (
    (1, 0.0, 16.0), (64, 0.0, 2.0), (256, 0.45, 1.05), (512, 0.465, 0.88), (1024, 0.445, 0.82), (2048, 0.425, 0.78), (4096, 0.385, 0.75), (8192, 0.34, 0.72), (16384, 0.3, 0.7), (32768, 0.28, 0.68),
    (65536, 0.26, 0.68), (131072, 0.24, 0.68), (262144, 0.22, 0.68), (524288, 0.2, 0.68), (1048576, 0.19, 0.68), (2097152, 0.18, 0.68),
)
CHUNK_BAND = (0.36, 0.75)
#: (bytes from, highest gain of the ratio without SYMBOLS); between two rows as for BANDS.
GAINS = ((1, 16.0), (256, 0.05), (1024, 0.02), (2048, 0.0145), (4096, 0.012))
SYMBOLS = np.zeros(256, bool)
_SIGNS = b"#*$%&|<>"
SYMBOLS[list(_SIGNS)] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunk_share double, symbol_gain double, base_failed boolean, band_failed boolean, kept boolean"


def limits(n: int) -> tuple[float, float]:
    x = [np.log2(b[0]) for b in BANDS]
    at = np.log2(max(n, 1))
    return float(np.interp(at, x, [b[1] for b in BANDS])), float(np.interp(at, x, [b[2] for b in BANDS]))


def highest_gain(n: int) -> float:
    return float(np.interp(np.log2(max(n, 1)), [np.log2(g[0]) for g in GAINS], [g[1] for g in GAINS]))


def _outside(ratio: float, n: int, band: tuple[float, float] | None = None) -> bool:
    low, high = band or limits(n)
    return not low <= ratio <= high


def bands(text: memoryview, press: zstandard.ZstdCompressor) -> tuple[float, float, float, bool]:
    """(ratio of the whole, share of bytes in chunks outside their band, gain without symbols, verdict)."""
    n = len(text)
    if not n:
        return 0.0, 0.0, 0.0, False
    ratio = len(press.compress(text)) / n
    bad = sum(len(c) for i in range(0, n, CHUNK) if _outside(len(press.compress(c := text[i : i + CHUNK])) / len(c), len(c), CHUNK_BAND if len(c) == CHUNK else None)) if n > CHUNK else 0
    plain = bytes(text).translate(None, _SIGNS)
    gain = len(press.compress(plain)) / len(plain) - ratio if 0 < len(plain) < n else 0.0
    return ratio, bad / n, gain, _outside(ratio, n) or bad >= BAD_SHARE * n or gain > highest_gain(n)


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _doc_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))


def _seen(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value occurs twice or more in its doc, an equal one came earlier), for items in order of doc."""
    order = np.lexsort((value, doc))  # stable: equal items stay in order
    same = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


_LINE = np.zeros(256, bool)
_LINE[10] = True


def word_statistics(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = K.spans(data, off)
    words = K.span_hashes(data, starts, ends, lower=False)
    chars = _per_text(((data & 0xC0) != 0x80) & ~K.SPACE[data], off)
    grams, at = K.ngrams(words, first, 3)
    twice, _ = _seen(_doc_of(at), grams)
    covered = np.zeros(len(words) + 3, bool)
    pos = K.window_positions(first, at)[twice]
    for k in range(3):
        covered[pos + k] = True
    s, e, line_first = K.spans(data, off, _LINE)
    worded = np.searchsorted(starts, e) > np.searchsorted(starts, s)  # a word starts in it: words don't cross \n
    doc = _doc_of(line_first)
    _, later = _seen(doc[worded], K.span_hashes(data, s[worded], e[worded], lower=False))
    dup = np.bincount(doc[worded][later], minlength=len(off) - 1)
    return [np.diff(first), chars, _per_text(SYMBOLS[data], off), dup, _per_text(covered[: len(words)], first)]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for i, j, data, off in K.slices(batch.column(0)):
            stats = word_statistics(data, off)
            view = memoryview(np.ascontiguousarray(data))
            band = [bands(view[a:b], press) for a, b in zip(off[:-1], off[1:], strict=True)]
            base = (stats[0] < MIN_WORDS) | (100 * stats[4] > REPEAT_PERCENT * stats[0])
            failed = np.array([b[3] for b in band], bool)
            own = [*(pa.array(x, pa.int64()) for x in stats), *(pa.array([b[k] for b in band], pa.float64()) for k in range(3)), pa.array(base), pa.array(failed), pa.array(~base & ~failed)]
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], *own], [*rows.schema.names[1:], *(x.split()[0] for x in SCHEMA.split(", "))])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and SCHEMA for each row of docs."""
    return texts(docs).select("text", "doc_id").mapInArrow(_judged, f"doc_id long, {SCHEMA}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns, which may be of any type and name."""
    return docs.where(judged(column("text"), _judged, lambda out: out.column("kept").combine_chunks()))
