"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is split into two segments of 32. Two fingerprints at
3 or fewer differing bits differ in at most 1 bit of one segment, so each
fingerprint looks up, for each segment, its value and the Hamming ball of
radius 1 around it in a table of all segment values. Of the two fingerprints of
a pair one has 0 at the differing bit, so only balls upward (a 0 made 1) are
enumerated. Fingerprints that meet at a table entry are verified by their
complete distance, and components are built over the links.

Copies cost nothing: the search runs over distinct fingerprints. At a table
entry not all pairs are emitted but a spanning forest of its links, and an
entry of many fingerprints is dealt out by pieces of the other segment, one of
which two linked fingerprints share, again and again until each part is small.

Defined cases: null, empty and white-space texts have fingerprint 0 and link
like any other. Texts are read whole, whatever their length. A null doc_id is a
component's id only if it has no other. Repeated rows each get a row (``keep_one``
keeps one of them; of several texts of one doc_id that of the least hash). An
empty table gives no rows. Other columns are ignored, whatever their names, and
kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, frugal, let, sql, written
from .components import components

WORDS = 3
DISTANCE = 3
_NULL_ID = 2**63 - 1
#: Fingerprints at one table entry above which it is dealt out again, and how often at most: after 7 times 28 of 32 bits are named.
CROWDED = 4096
LEVELS = 7
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str, n: int = WORDS) -> int:
    """The SimHash of a text's n-word shingles, unsigned."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return _hash(joined)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-n] + 1).tolist()]
    h = np.fromiter(map(_hash, [joined[i:j] for i, j in zip(starts, ends[n - 1 :].tolist(), strict=True)]), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        fp = np.fromiter((fingerprint(texts[i].as_py(), n) for i in range(len(texts))), np.uint64, len(texts))
        yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, th, fp): the 64 bits as a signed long, and a hash of the text."""
    rows = doc_texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(lambda it: frugal(_fingerprints(it, n)), "doc_id long, th long, fp long")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    out, left = [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                todo += list(found)
                left = left[~near]
    return out


def _verify(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each key; rows come sorted by it."""
    carry_k, carry_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        n = np.diff(cuts)
        at = cuts[:-1][n == 2]
        at = at[np.bitwise_count(fps[at] ^ fps[at + 1]) <= distance]
        a, b = [fps[at]], [fps[at + 1]]
        for i in np.flatnonzero(n > 2):
            if pairs := _forest(np.unique(fps[cuts[i] : cuts[i + 1]]), distance):
                a.append(np.array([p[0] for p in pairs], np.uint64))
                b.append(np.array([p[1] for p in pairs], np.uint64))
        yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([carry_k, batch.column("key").to_numpy()])
        fps = np.concatenate([carry_f, batch.column("fp").to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from links(keys[:cut], fps[:cut])
        carry_k, carry_f = keys[cut:], fps[cut:]
    yield from links(carry_k, carry_f)


def _dealt(crowded: DataFrame) -> DataFrame:
    """(fp, key, mask): rows of crowded keys, each under four keys more.

    Two fingerprints that link differ in 3 or fewer bits of the segment that is not the key's, so of four pieces that
    make up its bits outside mask they share one whole. A new key is the old one and the bits of one piece.
    """
    other = "if((key & 4294967296L) <> 0L, shiftrightunsigned(fp, 32), fp & 4294967295L)"
    free = "filter(sequence(0, 31), i -> (shiftrightunsigned(mask, i) & 1L) = 0L)"
    pieces = let(free, "f", "transform(sequence(0, 3), j -> aggregate(slice(f, j * ((size(f) + 3) div 4) + 1, (size(f) + 3) div 4), 0L, (a, i) -> a | shiftleft(1L, i)))")
    # The table stays the one of the key: its bit 32 is carried over.
    named = f"struct((xxhash64(key, p, {other} & p) & 4294967295L) | (key & 4294967296L) | (xxhash64(p, {other} & p, key) & -8589934592L) AS key, mask | p AS mask)"
    return crowded.select("fp", F.explode(sql(f"transform({pieces}, p -> {named})")).alias("r")).select("fp", "r.key", "r.mask")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) at 3 or fewer bits."""
    crowd = CROWDED
    table = fps.select(
        "fp",
        F.explode(
            sql(
                "transform(array(shiftrightunsigned(fp, 32), fp & 4294967295L), (v, s) -> struct("
                "s * 4294967296L + v AS own, "
                "transform(filter(sequence(0, 31), i -> (shiftrightunsigned(v, i) & 1L) = 0L), i -> s * 4294967296L + (v | shiftleft(1L, i))) AS ball))"
            )
        ).alias("s"),
    )
    rows = table.select(
        "fp", F.explode(sql("concat(array(struct(s.own AS key, true AS own)), transform(s.ball, k -> struct(k AS key, false AS own)))")).alias("r")
    ).select("fp", "r.key", "r.own")
    met = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("own AND n > 1").select("key", "n"))
    meeting = rows.select("fp", "key").join(met, "key").withColumn("mask", F.lit(0).cast("long"))
    small = meeting.where(F.col("n") <= crowd).select("fp", "key")
    most = met.agg(F.max("n")).first()[0] or 0
    # Entries of many fingerprints are dealt out again and again, until each is small or names all bits but a few.
    for _ in range(LEVELS):
        if most <= crowd:
            break
        again = written(_dealt(meeting.where(F.col("n") > crowd)))
        counts = again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        meeting = again.join(counts, "key")
        small = small.unionByName(meeting.where(F.col("n") <= crowd).select("fp", "key"))
        most = counts.agg(F.max("n")).first()[0] or 0
    else:
        small = small.unionByName(meeting.where(F.col("n") > crowd).select("fp", "key"))
    dealt = small.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: frugal(_verify(it, DISTANCE)), "a long, b long").distinct()


def _groups(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, first): the first row of each distinct fingerprint's component.

    Rows are ordered by doc_id, nulls last, then by the hash of the text.
    """
    every = written(fingerprints(docs, n))
    row = F.struct(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("k"), "th")
    fps = written(every.groupBy("fp").agg(F.min(row).alias("least")))
    stars = components(links(fps.select("fp")), "a", "b")
    labelled = fps.join(stars, fps.fp == stars.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("least").alias("first"))
    return every, labelled.join(firsts, "label").select("fp", "first")


def simhash_near_dedup(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the component)."""
    every, groups = _groups(docs, n)
    return every.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("first.k"), F.lit(_NULL_ID)).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One row of each component, all columns: that of the smallest doc_id (nulls last, ties by the text's hash)."""
    groups = _groups(docs, n)[1]
    firsts = groups.select(F.col("first.k").alias("k"), F.col("first.th").alias("th")).distinct()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    flat = docs.toDF(*names)
    keyed = flat.withColumns({"k": F.coalesce(F.col(of["doc_id"]).cast("long"), F.lit(_NULL_ID)), "th": F.xxhash64(F.coalesce(F.col(of["text"]), F.lit("")))})
    return keyed.join(firsts, ["k", "th"], "left_semi").dropDuplicates(["k", "th"]).select(*names).toDF(*docs.columns)
