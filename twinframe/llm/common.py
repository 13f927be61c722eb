"""What several of the text operators share: reading tables, byte-level word hashing, batches by size."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The functions of this module that run in tasks travel to the executors with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Word characters of the contracts: all but the six ASCII white-space characters; letters, digits and all non-ASCII bytes.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that numpy handles at once; its intermediates take about 60 times as much.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that goes from Spark to a Python worker or back, where the session sets no bound itself.
BATCH_BYTES = 4 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_by_bytes(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session by bytes, as 10,000 whole texts may be of any size."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def lower_ascii(column):
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(columns: list[str], name: str) -> str:
    """``name``, longer if a column has it already."""
    while name.lower() in [c.lower() for c in columns]:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of the public SplitMix64 generator: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of those rows in the bytes): runs of rows of about CHUNK_BYTES; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | np.uint8(0x20), data)


def word_bytes(pattern: str) -> np.ndarray:
    """Which bytes belong to words, by one of the two patterns above."""
    if pattern == SPACE_WORDS:
        out = np.ones(256, bool)
        out[[32, *range(9, 14)]] = False
    else:
        out = np.zeros(256, bool)
        out[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): the words of a slice, and for each of its rows where its words begin in that list."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else np.zeros(0, bool)
    after = np.concatenate([inside[1:], [False]]) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, by prefix sums of a polynomial; equal words have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        powers = np.full(len(data) + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers[:-1], out=total[1:])
        back = np.full(len(data) + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
