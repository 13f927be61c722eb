"""Exact Jaccard self-join of texts on word n-grams, by universe partition and the pigeonhole principle.

Sets. A text is its distinct n-grams of words, each a 64-bit hash; texts with equal sets form one class, known by a
128-bit digest of the set, and only classes are compared.

Signatures. Sizes are cut into bands whose bounds grow by 1/threshold, so partners are in the same or neighbouring bands.
Two sets of a band, or of it and the next, that reach the threshold differ in at most H elements. The band's scheme hashes
the universe into segments and gives each an allowance: a segment of allowance 1 must be equal in both sets, one of
allowance 2 equal up to one element deleted on either side. If the allowances add up to H + 1, partners must agree in a
segment. Two sets may agree in segments that are empty in both, or hold a passage of many texts, which says little; so the
allowances add up to more by a number of spare ones: partners then agree in more segments than that, and each set leaves out
as many signatures of segments of allowance 1, those that come first in one order of all signatures: empty segments, then by
how common the rarest element is. Of the signatures that partners share, the last in that order is left out by neither,
whatever the order; so how common elements are is taken from a bounded sample. A set emits, under its own band's scheme and
that of the band below, a signature per segment left, and for allowance 2 one more for each deletion. How many segments get
allowance 2, and how many are spare (a quarter of H at least), is chosen per band by cost: signatures written against the
chance matches expected among the band's classes, counted over the whole corpus.

Candidates. A task ties its classes that share a signature to one of them and passes each signature on once, so that one
of a third of all texts passes once per task. Signatures are dealt by their high bits into buckets, and a row is what a task
has for a bucket: ``SIGN`` bytes of a signature and ``OWNER`` bytes of its class, no more, as these are most of what is
shuffled. Signatures or classes that those bytes take for one another join two clusters, which loses nothing. After the
shuffle the signatures of a bucket are tied alike. All ties together make clusters (connected components), which hold all
partners whatever their number.

Verification. Shared passages chain clusters up, so they are cut first: sketches of 512 bytes bound from below how many
elements two sets differ in, and only sets connected by pairs that they allow stay together. Then the sets are compared.
Both times a cluster is cut into pieces of two neighbouring bands, as only sets of these can be partners, and a piece is
dealt by hash into blocks; every pair of blocks is a group of its own, small enough for any
executor, in which numpy compares all sets of one with all of the other (intersections by one matrix product). A group
passes on no pairs, but per set one tie that says what it is connected to, and its number of links. A cluster of g sets is
copied to at most ``SPREAD`` pairs of small blocks a set; beyond these its blocks grow up to a bound, and from there on it
costs g squared divided by the sets of such a block in rows.

A text with fewer than n words is its whole sequence as one n-gram. Null texts and those without words have empty sets
and no links. Repeated rows are members of one class. Rows with a null id take part and come out with the component of
their class; a component of null ids only has a null id. Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import SPACE_WORDS, folded, mix, text_slices, word_bytes, word_hashes, word_spans
from twinframe.llm.components import components
from twinframe.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of a sketch, a power of two.
PARTS = 512
#: Elements of a block of sets, and sketches of a block; a group of verification has two blocks.
BLOCK, SKETCHES = 16_384, 256
#: Blocks of that size that a cluster is cut into, at most, before they grow; and the most that they grow to: elements, sets.
SPREAD, LARGE_BLOCK, LARGE_SETS = 8, 262_144, 1024
#: For the cost only: the chance that one element of a set is a given element of another.
SHARED = 1e-3
#: Texts, about, from which the common elements are known, and how many of those.
SAMPLE, COMMON = 16_384, 65_536
#: Signatures that a task combines at a time.
FLUSH = 2_000_000
#: Bytes kept of a signature besides its bucket, and of a class; buckets at least, and elements of sets for one more of them.
SIGN, OWNER, BUCKETS, BUCKET = 5, 6, 8192, 262_144
#: Text hashes (8 bytes each) that may be broadcast to pick the texts of candidates; beyond it Spark shuffles.
BROADCAST_ROWS = 2_000_000
_FIRST, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Scheme(NamedTuple):
    """Segments of a band, how many of them, the first ones, have allowance 2, and by how much the allowances exceed H + 1."""

    segments: int
    double: int
    spare: int = 0


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of each text of a slice, sorted."""
    data = folded(data)
    starts, ends, bounds = word_spans(data, offsets, word_bytes(SPACE_WORDS))
    words = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(words), np.uint64)
        for k in range(n):
            whole = max(0, len(words) - k)
            grams[:whole] = mix(grams[:whole] * _FIRST + words[k:] + np.uint64(k + 1))
        out = []
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if last - first >= n:
                out.append(np.unique(grams[first : last - n + 1]))
            elif last > first:
                whole = np.uint64(0)
                for w in words[first:last]:
                    whole = mix(np.array([whole * _SECOND + w]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    with np.errstate(over="ignore"):
        halves = [mix(np.array([mix(items ^ salt).sum(dtype=np.uint64) + np.uint64(len(items))])) for salt in (_FIRST, _SECOND)]
    return int(halves[0].view(np.int64)[0]), int(halves[1].view(np.int64)[0])


def sketch(items: np.ndarray) -> bytes:
    """How many elements fall into each of ``PARTS`` parts of the universe, 255 at most: these differ by no more than the sets do."""
    part = (items & np.uint64(PARTS - 1)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=PARTS), 255).astype(np.uint8).tobytes()


def bounds_up_to(largest: int, percent: int) -> list[int]:
    """Smallest sizes of the bands: a partner of a set in band b is in b - 1, b or b + 1."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


def most_apart(bounds: list[int], band: int, percent: int) -> int:
    """The largest symmetric difference of two sets that reach the threshold, the smaller one in the band."""
    size = bounds[band + 1] - 1
    return (100 - percent) * (size + size * 100 // percent) // (100 + percent)


def allocate(bounds: list[int], counts: dict[int, int], percent: int) -> list[Scheme]:
    """The cheapest scheme per band, given how many classes each band has."""
    schemes = []
    for band in range(len(bounds) - 1):
        apart, size = most_apart(bounds, band, percent), bounds[band + 1] - 1
        near = counts.get(band, 0) + counts.get(band + 1, 0)

        def cost(choice: tuple[int, int], apart: int = apart, size: int = size, near: int = near) -> float:
            double, spare = choice
            segments = apart + 1 - double + spare
            each = size / segments
            empty = math.exp(-each)
            mean = (segments - double) * empty
            # More empty segments than spare ones, on both sides; equal single elements; at most one element on both sides.
            few = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(spare + 1)] if mean else [1.0]
            beyond = max(0.0, 1 - sum(few))
            chance = beyond**2 + (segments - double) * SHARED * (each * empty) ** 2 + double * ((1 + each) * empty) ** 2
            return segments - spare + double * each + near * chance

        doubles = sorted({(apart + 1) // 2 * k // 16 for k in range(17)})
        spares = sorted({s for s in (1, 2, 3, *(apart * k // 32 for k in range(13))) if s >= apart // 4})
        double, spare = min(((d, s) for d in doubles for s in spares), key=cost)
        schemes.append(Scheme(apart + 1 - double + spare, double, spare))
    return schemes


def signatures(items: np.ndarray, band: int, scheme: Scheme, often: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set under the scheme of a band; ``often`` tells how common each element is, alike in all sets."""
    with np.errstate(over="ignore"):
        place = ((items >> np.uint64(32)) * np.uint64(scheme.segments) >> np.uint64(32)).astype(np.int64)
        mixed = mix(items + np.uint64(band * 2 + 1) * _SECOND)
        # Sets are sorted and segments are ranges of hashes, so each segment is a run.
        edges = np.searchsorted(place, np.arange(scheme.segments + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        sums = total[edges[1:]] - total[edges[:-1]]
        salt = mix((np.arange(scheme.segments, dtype=np.uint64) + np.uint64(1)) * _FIRST + np.uint64(band))
        whole = mix(sums + salt)
        kept = np.ones(scheme.segments, bool)
        if scheme.spare:
            filled = edges[1:] > edges[:-1]
            rarest = np.full(scheme.segments, np.iinfo(np.int64).max)
            rarest[filled] = 0 if often is None else np.minimum.reduceat(often, edges[:-1][filled])
            order = np.lexsort((whole, -rarest))
            kept[order[order >= scheme.double][: scheme.spare]] = False
        out = [whole[kept]]
        if scheme.double:
            stop = edges[scheme.double]
            out.append(mix(sums[place[:stop]] - mixed[:stop] + salt[place[:stop]]))
    return np.concatenate(out)


def _common(rows: DataFrame, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that are in two or more sets of a sample of the ``texts`` different texts, sorted, and in how many; ``COMMON`` at most."""
    share = max(1, texts // SAMPLE)
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "t"), F.lit(share)) == 0).select("t", "text").dropDuplicates(["t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                if sets := ngram_sets(data, offsets, n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["item"])

    counted = picked.select("text").mapInArrow(run, "item bigint").groupBy("item").count().where("count > 1")
    known = counted.orderBy(F.desc("count"), "item").limit(COMMON).toArrow()
    items, often = np.asarray(known.column("item")).view(np.uint64), np.asarray(known.column("count"))
    order = np.argsort(items)
    return items[order], often[order]


def how_common(items: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """In how many sets of the sample the elements are, 0 for those not known."""
    if not len(known):
        return np.zeros(len(items), np.int64)
    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
    return np.where(known[at] == items, often[at], 0)


def _members(docs: DataFrame, n: int) -> DataFrame:
    """(id, text hash, size, digest, sketch) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b, sketches = [], [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                for items in ngram_sets(data, offsets, n):
                    size.append(len(items))
                    d = digest(items)
                    a.append(d[0])
                    b.append(d[1])
                    sketches.append(sketch(items))
            numbers = [pa.array(x, pa.int64()) for x in (size, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), *numbers, pa.array(sketches, pa.binary())], ["id", "t", "n", "a", "b", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, t bigint, n bigint, a bigint, b bigint, sketch binary")


def combined(signs: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature rows of a task, combined: each signature once, with the same class twice, and ties of the other classes to that one under signatures of their own."""
    order = np.argsort(signs, kind="stable")
    signs, owners = signs[order], owners[order]
    fresh = np.append(True, signs[1:] != signs[:-1])
    hub = owners[np.maximum.accumulate(np.where(fresh, np.arange(len(signs)), 0))]
    tied = ~fresh & (owners != hub)
    ties = np.unique(np.stack([owners[tied], hub[tied]]), axis=1)
    with np.errstate(over="ignore"):
        spread = mix(ties[0].view(np.uint64) * _FIRST + ties[1].view(np.uint64)).view(np.int64)
    return np.concatenate([signs[fresh], spread]), np.concatenate([owners[fresh], ties[0]]), np.concatenate([owners[fresh], ties[1]])


def low_bytes(numbers: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of 64-bit numbers, a row each."""
    return np.ascontiguousarray(numbers).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]


def from_low_bytes(rows: np.ndarray) -> np.ndarray:
    """Numbers of which :func:`low_bytes` are given, the other bytes 0."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<i8").ravel()


def bucketed(s: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Combined signature rows as a row per bucket: signatures with their class, and ties of two classes, packed."""
    of = ((s.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of, s, a, b = of[order], s[order], a[order], b[order]
    known = np.unique(of)
    columns = [pa.array(known, pa.int32())]
    for which, first, width in ((a == b, s, SIGN), (a != b, b, OWNER)):
        packed = np.concatenate([low_bytes(first[which], width), low_bytes(a[which], OWNER)], axis=1)
        ends = np.searchsorted(of[which], np.append(known, buckets)) * packed.shape[1]
        columns.append(pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed.tobytes())]))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "signs", "ties"])


def _signed(docs: DataFrame, n: int, bounds: list[int], schemes: list[Scheme], common: tuple[np.ndarray, np.ndarray], buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, signs, ties) of :func:`bucketed`. A task combines what it has, ``FLUSH`` signatures at a time."""
    edges = np.array(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        signs, owners, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return bucketed(*combined(np.concatenate(signs), np.concatenate(owners)), buckets)

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                for items in ngram_sets(data, offsets, n):
                    if not len(items) or (d := digest(items)) in done:
                        continue
                    done.add(d)
                    band = int(np.searchsorted(edges, len(items), "right")) - 1
                    often = how_common(items, *common)
                    for of in range(max(0, band - 1), band + 1):
                        signs.append(signatures(items, of, schemes[of], often).view(np.int64))
                        owners.append(np.full(len(signs[-1]), d[0], np.int64))
                        held += len(signs[-1])
                if held > FLUSH:
                    yield flush()
                    signs, owners, held = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, signs binary, ties binary")


def _ties(signed: DataFrame) -> DataFrame:
    """Distinct ties (a, b) of classes, known by their low bytes, that share a signature, each to one of them."""

    def tied(signs: list[bytes], ties: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, SIGN + OWNER)
        rows = rows[np.argsort(from_low_bytes(rows[:, :SIGN]), kind="stable")]
        s, a = from_low_bytes(rows[:, :SIGN]), from_low_bytes(rows[:, SIGN:])
        fresh = np.append(True, s[1:] != s[:-1])[: len(s)]
        to = a[np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))]
        pairs = np.frombuffer(b"".join(ties), np.uint8).reshape(-1, 2 * OWNER)
        a, to = np.append(a, from_low_bytes(pairs[:, OWNER:])), np.append(to, from_low_bytes(pairs[:, :OWNER]))
        found = np.unique(np.stack([a, to])[:, a != to], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, signs, ties = None, [], []
        for batch in batches:
            for bucket, *own in zip(*[batch.column(c).to_pylist() for c in ("bucket", "signs", "ties")], strict=True):
                if bucket != key:
                    if signs:
                        yield tied(signs, ties)
                    key, signs, ties = bucket, [], []
                signs.append(own[0])
                ties.append(own[1])
        if signs:
            yield tied(signs, ties)

    return signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(digest, size, set) rows; a task emits a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                rows = []
                for items in ngram_sets(data, offsets, n):
                    if len(items) and (d := digest(items)) not in done:
                        done.add(d)
                        rows.append((*d, len(items), items.view(np.int64)))
                if rows:
                    a, b, size, items = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["a", "b", "n", "items"])

    return docs.select("text").mapInArrow(run, "a bigint, b bigint, n bigint, items array<bigint>")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets at ``left`` (rows) reach the threshold with which at ``right`` (columns)."""
    size = np.array([len(x) for x in sets])
    codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    # Only elements of two sets or more can be common.
    common = np.flatnonzero(np.bincount(flat, minlength=len(codes)) > 1)
    column = np.full(len(codes), -1)
    column[common] = np.arange(len(common))
    both = np.zeros((len(left), len(right)), np.float32)
    row = np.full(len(sets), -1)
    for at in range(0, len(common), 8192):
        wide = min(8192, len(common) - at)
        here = (column[flat] >= at) & (column[flat] < at + wide)
        halves = []
        for part in (left, right):
            row[:] = -1
            row[part] = np.arange(len(part))
            used = here & (row[owner] >= 0)
            m = np.zeros((len(part), wide), np.float32)
            m[row[owner[used]], column[flat[used]] - at] = 1
            halves.append(m)
        both += halves[0] @ halves[1].T
    union = size[left][:, None] + size[right][None] - both
    return 100 * both >= percent * union


def perhaps_linked(sketches: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """The same by sketches: false only where the sets cannot reach the threshold. Small sets need fewer parts, so some are added up."""
    parts = min(PARTS, max(64, 1 << int(size.max() // 16).bit_length()))
    folded_up = np.stack(sketches).astype(np.int32).reshape(len(sketches), -1, parts).sum(axis=1)
    x, y = folded_up[left], folded_up[right]
    apart = np.zeros((len(left), len(right)), np.int32)
    for k in range(parts):
        apart += np.abs(x[:, k][:, None] - y[:, k][None])
    total = size[left][:, None] + size[right][None]
    return 100 * (total - apart) >= percent * (total + apart)


def roots(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest one connected to it by the pairs of ``left`` and ``right`` that are near."""
    label = np.arange(n)
    while True:
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(near, label[right][None], n).min(axis=1))
        label[right] = np.minimum(label[right], np.where(near, label[left][:, None], n).min(axis=0))
        if np.array_equal(before, label):
            return label


def _pieces(sets: DataFrame) -> DataFrame:
    """A cluster cut by size: piece b has the sets of band b, and those of band b + 1 as ``upper`` ones, which are compared with the others only."""
    twice = sets.select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("piece")).where("piece >= 0")
    return twice.withColumn("upper", F.col("piece") < F.col("band")).withColumn("cluster", F.concat_ws(":", "cluster", "piece"))


def _blocks(small, large=None):
    """Blocks of a cluster that would be cut into ``small`` or ``large`` blocks; one of more than ``SPREAD`` small ones takes larger blocks."""
    bounds = [F.count("*") / LARGE_SETS] + ([] if large is None else [large])
    return F.ceil(F.greatest(F.least(small, F.lit(SPREAD)), *bounds)).cast("int")


def _dealt(sets: DataFrame, payload: str) -> DataFrame:
    """Sets (cluster, node, n, upper, blocks, payload) dealt by hash into the blocks of their cluster, and a copy to each pair (i, j) that their block is in, these standing together."""
    placed = sets.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = placed.select("cluster", "node", "n", "upper", "block", payload, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "upper", "block", F.col(payload).alias("payload"))
    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]]:
    """(nodes, sizes, left, right, payloads, which pairs to compare) of each pair of blocks in a sorted partition."""

    def group(rows: list, i: int, j: int):
        blocks = np.array([r[2] for r in rows])
        left, right, upper = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j), np.array([r[4] for r in rows])
        asked = ~(upper[left][:, None] & upper[right][None])
        if i == j:
            np.fill_diagonal(asked, False)
        return [r[0] for r in rows], np.array([r[1] for r in rows]), left, right, [r[3] for r in rows], asked

    key, rows = None, []
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "node", "n", "block", "upper")]
        payload = batch.column("payload")
        # Copies, so that a batch is not held for the few of its rows that wait for the next one.
        if pa.types.is_list(payload.type):
            values, ends = np.asarray(payload.values).view(np.uint64), np.asarray(payload.offsets)
            own = [values[ends[k] : ends[k + 1]].copy() for k in range(len(payload))]
        else:
            own = [np.frombuffer(x, np.uint8) for x in payload.to_pylist()]
        for cluster, i, j, node, n, block, upper, data in zip(*names, own, strict=True):
            if (cluster, i, j) != key:
                if len(rows) > 1:
                    yield group(rows, *key[1:])
                key, rows = (cluster, i, j), []
            rows.append((node, n, block, data, upper))
    if len(rows) > 1:
        yield group(rows, *key[1:])


def _tied_by_sketch(dealt: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) that connect the sets whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, size, left, right, sketches, asked in _groups(batches):
            if asked.any():
                root = roots(perhaps_linked(sketches, size, left, right, percent) & asked, left, right, len(nodes))
                tied = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in tied], pa.string()), pa.array([nodes[root[k]] for k in tied], pa.string())], ["a", "b"])

    return dealt.mapInArrow(run, "a string, b string").distinct()


def _verified(dealt: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, n_links): ties that connect linked sets, and, where b is null, how many links a set has in a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, _, left, right, sets, asked in _groups(batches):
            if not asked.any():
                continue
            near = linked(sets, left, right, percent) & asked
            root = roots(near, left, right, len(nodes))
            tied = np.flatnonzero(root != np.arange(len(root)))
            links = np.zeros(len(nodes), np.int64)
            links[left] += near.sum(axis=1)
            if left[0] != right[0]:
                links[right] += near.sum(axis=0)
            some = np.flatnonzero(links)
            a = [nodes[k] for k in tied] + [nodes[k] for k in some]
            b = [nodes[root[k]] for k in tied] + [None] * len(some)
            n = [0] * len(tied) + links[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["a", "b", "n_links"])

    return dealt.mapInArrow(run, "a string, b string, n_links bigint")


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): per row its ``id``, text hash ``t``, set size ``n`` and class ``node`` (null if the set is empty); and the rows of ``_verified``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(text_col).alias("t"))
    members = stored(_members(rows, n), "members")
    classes = members.where("n > 0").select("a", "b", "n").distinct()
    bounds = bounds_up_to(members.agg(F.max("n")).first()[0] or 0, percent)
    band = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("n"))) - 1
    bands = classes.groupBy(band.alias("band")).agg(F.count("*").alias("classes"), F.sum("n").alias("items")).collect()
    counts = {r.band: r.classes for r in bands}
    schemes = allocate(bounds, counts, percent)

    common = _common(rows, sum(counts.values()), n)
    buckets = max(BUCKETS, sum(r["items"] for r in bands) // BUCKET)
    ties = _ties(_signed(rows, n, bounds, schemes, common, buckets))
    clusters = components(ties).select(F.col("node").alias("owner"), F.col("label").alias("cluster"))
    owner = F.col("a").bitwiseAND(F.lit((1 << 8 * OWNER) - 1))
    kinds = members.where("n > 0").withColumn("owner", owner).join(clusters, "owner").groupBy("cluster", "a", "b", "n")
    near = stored(kinds.agg(F.min("t").alias("t"), F.first("sketch").alias("sketch")).withColumns({"node": _node(), "band": band}), "near")
    pieces = _pieces(near)
    coarse = pieces.groupBy("cluster").agg(_blocks(F.count("*") / SKETCHES).alias("blocks"), F.count("*").alias("sets"), F.count_if(~F.col("upper")).alias("own")).where("sets > 1 AND own > 0")
    sketched = pieces.join(coarse, "cluster").select("cluster", "node", "n", "upper", "blocks", "sketch")
    fine = components(_tied_by_sketch(_dealt(sketched, "sketch"), percent)).select("node", F.col("label").alias("cluster"))

    left = stored(near.drop("cluster", "sketch").join(fine, "node"), "candidates")
    pieces = _pieces(left)
    blocks = pieces.groupBy("cluster").agg(_blocks(F.sum("n") / BLOCK, F.sum("n") / LARGE_BLOCK).alias("blocks"), F.count("*").alias("sets"), F.count_if(~F.col("upper")).alias("own")).where("sets > 1 AND own > 0")
    wanted = left.select("t").distinct()
    if left.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = _sets(rows.join(wanted, "t", "left_semi"), n).withColumn("node", _node()).dropDuplicates(["node"])
    placed = sets.join(pieces.join(blocks, "cluster").select("node", "cluster", "upper", "blocks"), "node").select("cluster", "node", "n", "upper", "blocks", "items")
    links = stored(_verified(_dealt(placed, "items"), percent), "links")
    return members.select("id", "t", "n", F.when(F.col("n") > 0, _node()).alias("node")), links


def _node():
    return F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n`` (set size), ``n_links`` (links of its class) and ``component`` (smallest id reachable by links, its own included)."""
    members, links = jaccard_links(docs, n, percent, id_col, text_col)
    labels = components(links.where("b IS NOT NULL").select("a", "b"))
    degrees = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
    linked = labels.join(degrees, "node")
    classes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    labelled = classes.join(linked, "node", "left").where("rows > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled")
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component"))
    known = labelled.join(firsts, "label").select("node", "n_links", "component")
    return members.join(known, "node", "left").select("id", "n", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (null comes last), then text hash; with its columns. Texts without words stay."""
    members, links = jaccard_links(docs, n, percent, id_col, text_col)
    labels = components(links.where("b IS NOT NULL").select("a", "b"))
    rows = members.where("node IS NOT NULL").join(labels, "node", "left").select("id", "t", F.coalesce("label", "node").alias("label"))
    rows = stored(rows, "labels").withColumn("order", F.struct(F.col("id").isNull(), "id", "t"))
    groups = rows.groupBy("label").agg(F.min("order").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("label", "first")
    grouped = stored(rows.join(groups, "label").select("id", "t", (F.col("order") == F.col("first")).alias("stays")), "grouped")
    gone = grouped.where("NOT stays").select("id", "t").distinct()
    twice = grouped.where("stays").groupBy("id", "t").count().where("count > 1").select("id", "t")
    if grouped.count() <= BROADCAST_ROWS:
        gone, twice = F.broadcast(gone), F.broadcast(twice)
    same = lambda keys: docs[id_col].eqNullSafe(keys["id"]) & (F.xxhash64(docs[text_col]) == keys["t"])
    kept = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, same(twice), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, same(twice), "left_anti").unionByName(again)
