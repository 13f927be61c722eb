"""Byte-level BPE encoding and decoding, long texts by tree concatenation.

A text longer than a leaf is cut into leaves, which become rows of their own: Spark spreads them over all tasks, they are
encoded in parallel, brought together by text and joined pairwise from the bottom, like halves of halves. At each join a window of tokens around the cut is encoded anew. If its outer tokens on
both sides are those that the halves have there, the window replaces them; else it grows to twice its size, at worst to
all of both halves. Two facts make agreement sufficient: pre-tokens depend on the text to their right only as far as they
reach plus one character, and a sequence of tokens is the encoding of its pre-token if each neighbouring pair is.

The ranks come from the vocabulary file of a ``tokenizers`` byte-level BPE model, read on each executor; merging is done
by ``tiktoken``, which is several times as fast as, and gives the ids of, the library the file belongs to. Encoding and
decoding share one Python worker a task.

Null texts read as empty. An empty text has no tokens and decodes to an empty text. Ids that are null decode to null.
Extra columns are ignored, repeated rows stay, an empty table gives an empty table.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import batches_by_bytes
from twinframe.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the pre-token pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, and tokens on each side of a join that are encoded anew at first.
LEAF_CHARS = 16384
WINDOW = 8


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in the file: visible Latin-1 characters for themselves, the rest from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, symbols = content["model"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("The ids of this vocabulary do not follow its merges")
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.lengths = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.lengths[i] = len(token)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.engine.encode(text, allowed_special="all", disallowed_special=()), np.uint32)

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> np.ndarray:
        """The ids of the whole text."""
        if len(text) <= leaf:
            return self.plain(text)
        pieces = [text]
        while max(map(len, pieces)) > leaf:
            pieces = [half for p in pieces for half in (p[: len(p) // 2], p[len(p) // 2 :])]
        return self.joined([(p.encode(), self.plain(p)) for p in pieces])

    def joined(self, level: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """The ids of a text from those of its leaves, neighbours joined until one is left."""
        while len(level) > 1:
            pairs = [self.join(*a, *b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[2 * len(pairs) :]
        return level[0][1]

    def join(self, a: bytes, left: np.ndarray, b: bytes, right: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The encoding of ``a + b`` from those of both."""
        data = a + b
        if not len(left) or not len(right):
            return data, np.concatenate([left, right])
        begins = np.concatenate([[0], np.cumsum(self.lengths[left])])
        ends = len(a) + np.concatenate([[0], np.cumsum(self.lengths[right])])
        whole = lambda at: at >= len(data) or data[at] & 0xC0 != 0x80  # noqa: E731  not inside a character
        window = WINDOW
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            while not whole(int(begins[i])):
                i -= 1
            while not whole(int(ends[j])):
                j += 1
            ids = self.plain(data[begins[i] : ends[j]].decode())
            same = max(1, window // 4)
            head = i == 0 or np.array_equal(ids[:same], left[i : i + same])
            tail = j == len(right) or np.array_equal(ids[-same:], right[max(0, j - same) : j])
            if head and tail:
                return data, np.concatenate([left[:i], ids, right[j:]])
            window *= 2

    def decode(self, ids: np.ndarray) -> str:
        return self.engine.decode(ids.tolist(), errors="replace")


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _answers(rows: DataFrame, path: str, decoded: bool, kind: str, encoded) -> DataFrame:
    """(id, n_tokens, ids and, if asked, decoded) of ``rows``; ``encoded`` gives the ids of each row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            counts, packed, texts = [], [], []
            for ids in encoded(codec, batch):
                counts.append(len(ids))
                packed.append(_packed(ids))
                if decoded:
                    texts.append(codec.decode(ids))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
            names = ["id", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if decoded else [])], [*names, *(["decoded"] if decoded else [])])

    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary{', decoded string' if decoded else ''}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS, decoded: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens`` and ``ids`` (32-bit little-endian unsigned integers, packed), with ``decoded`` also what they stand for. ``path``: the vocabulary file, on every executor."""
    batches_by_bytes(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    is_long = F.length("text") > leaf

    def whole(codec: Codec, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (codec.plain(text.as_py()) for text in batch.column("text"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            ids = pa.array([_packed(x) for x in whole(codec, batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "at", "id", "text")], ids], ["row", "at", "id", "text", "ids"])

    def together(codec: Codec, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for parts in batch.column("parts"):
            yield codec.joined([(p["text"].encode(), np.frombuffer(p["ids"], "<u4")) for p in parts.as_py()])

    # The row number is stored with its text, so it stays the same if a task is run again.
    long = stored(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    cut = long.select("row", "id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))).alias("at", "text"))
    encoded = cut.repartition("row", "at").select("row", "at", "id", "text").mapInArrow(leaves, f"row bigint, at int, id {kind}, text string, ids binary")
    parts = encoded.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("at", "text", "ids"))).alias("parts"))
    out = _answers(rows.where(~is_long), path, decoded, kind, whole).unionByName(_answers(parts.select("id", "parts"), path, decoded, kind, together))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``encode`` with the text that their ids stand for, as ``decoded``."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            texts = [None if not x.is_valid else codec.decode(np.frombuffer(x.as_py(), "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), batch.column("ids"), pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    out = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids").mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")
