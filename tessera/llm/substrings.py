"""Substring dedup by a prefix-partitioned forest of sparse suffix trees.

A suffix is kept for each *anchor*: the 8-word run of least hash inside a window
of 20 words. A window's anchor depends on the window's words alone, so equal
windows hang below the same anchor, and one suffix speaks for the several
neighbouring windows that share its anchor. Suffixes are dealt out by a prefix
of their anchor's hash, in as many groups as the text's bytes ask for; a group
is one subtree. A first pass counts the windows below each of many finer
prefixes; below one that holds too many, the prefix is lengthened by the whole
window: each window is a suffix of its own there, dealt by its own hash. A subtree's edges are the windows below the anchor: those met
twice are its deep internal nodes, and each occurrence but the first (smallest
doc_id, then start) is a repeat. Anchors met once have no internal node and are
dropped at once. Neighbouring repeats are joined to maximal ones.

Skew: each task first settles the windows that repeat within what it reads, and
passes on one of each, so a passage that a third of all rows hold reaches its
subtree as a few suffixes a task, not one a row. The windows over the passage's
ends differ in each row and are not settled so; they share few anchors, whose
prefixes are the ones that the count makes longer.

Texts travel once, at the end, to the repeats found in them. Windows are first
told apart by 64 bits of anchor, 64 bits of window and the anchor's place in it.
Each repeat carries the earlier occurrence that it was found by, and where the
texts meet their repeats both occurrences' words are read: their 128-bit BLAKE2
digests must agree, or everything is done again with other hash values. Equal
words have equal hashes under any values, so a result that passes is exact.

Defined cases: null and empty texts have no words; a text of under 20 words has
no window and loses nothing. Texts are taken whole, whatever their length. A null
doc_id counts as the largest. Rows of one doc_id with different texts are told
apart by the text's hash, the smaller first; equal rows lose the same words. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, forget, frugal, partitions, written
from .wordhash import buffers, chunks, mix, roll, word_hashes

WINDOW = 20
ANCHOR = 8
#: Bytes of text that a map step holds as arrays, and that one subtree stands for.
CHUNK_BYTES = 6 << 20
GROUP_BYTES = 24 << 20
#: Groups of a subtree's share, prefixes counted for each, and the windows that one prefix may hold.
SPREAD = 4
FINER = 16
MOST_WINDOWS = 500_000
SEGMENT = 4096
_NULL_ID = 2**63 - 1
_GROUPS = pa.schema([("g", pa.int32()), ("suffixes", pa.binary())])
#: n windows from a word of a text on, and the text and word where an earlier occurrence of them starts.
_REPEATS = pa.schema([("k", pa.int64()), ("th", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("k0", pa.int64()), ("th0", pa.int32()), ("start0", pa.int32())])
_SPAN = np.dtype([("k", "<i8"), ("th", "<i4"), ("start", "<i4"), ("n", "<i4"), ("k0", "<i8"), ("th0", "<i4"), ("start0", "<i4")])
_CHECK = "k bigint, th int, start int, n int, d binary"
#: Sets of hash values that are tried, one after the other.
TRIES = 4
_SUFFIX = np.dtype([("key", "<u8"), ("k", "<i8"), ("th", "<i4"), ("start", "<i4"), ("off", "u1"), ("n", "u1")])


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of n parts each: the item of each part, and the part's number in it."""
    n = n.astype(np.int64)
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; breaks tells for each item but the first if a run starts there."""
    at = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    return at, np.diff(np.concatenate([at, [len(breaks) + 1]]))


class _Seen:
    """Windows known to repeat, with an occurrence each that this task has passed on."""

    MOST = 500_000

    def __init__(self) -> None:
        self.h = np.zeros(0, np.uint64)
        self.at = np.zeros(0, [("k", "<i8"), ("th", "<i4"), ("start", "<i4")])

    def later(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that come after the occurrence held of them, and those occurrences."""
        if not len(self.h):
            return np.zeros(0, np.int64), self.at
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero(self.h[i] == h)
        own, old = at[hit], self.at[i[hit]]
        after = (own["k"] > old["k"]) | ((own["k"] == old["k"]) & ((own["th"] > old["th"]) | ((own["th"] == old["th"]) & (own["start"] > old["start"]))))
        return hit[after], old[after]

    def add(self, h: np.ndarray, at: np.ndarray) -> None:
        room = self.MOST - len(self.h)
        if room <= 0 or not len(h):
            return
        both, where = np.unique(np.concatenate([self.h, h[:room]]), return_index=True)
        self.h, self.at = both, np.concatenate([self.at, at[:room]])[where]


def _values(salt: int) -> np.ndarray | None:
    """The bytes' values that words are hashed by: those of wordhash, or others for each salt above 0."""
    return np.random.default_rng([salt, 20]).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) if salt else None


def _spans_of(place: np.ndarray, source: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Runs of repeated windows (at place, first met at source); breaks tells where a run cannot go on."""
    if not len(place):
        return np.zeros(0, _SPAN)
    moved = (np.diff(source["k"]) != 0) | (np.diff(source["th"]) != 0) | (np.diff(source["start"]) != 1)
    a, n = _runs(breaks | moved)
    out = np.empty(len(a), _SPAN)
    for c in ("k", "th", "start"):
        out[c], out[c + "0"] = place[c][a], source[c][a]
    out["n"] = n
    return out


def _part(h: np.ndarray, n: int) -> np.ndarray:
    """The leading part of hashes, mixed anew, as one of n: anchors are minima, so their own top bits are low."""
    return ((mix(h) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _records(chunk: pa.RecordBatch, window: int, anchor: int, seen: _Seen, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeats within a chunk's texts, the suffixes of the rest, and the windows' hashes suffix by suffix."""
    none = np.zeros(0, _SPAN), np.zeros(0, _SUFFIX), np.zeros(0, np.uint64)
    ids = chunk.column("k").to_numpy(zero_copy_only=False)
    ths = chunk.column("th").to_numpy(zero_copy_only=False)
    order = np.lexsort((ths, ids))
    same = (np.diff(ids[order]) == 0) & (np.diff(ths[order]) == 0)
    order = order[np.concatenate([[True], ~same])]
    ids, ths = ids[order], ths[order]
    data, off = buffers(chunk.column("text").take(pa.array(order)))
    values = _values(salt)
    h, counts = word_hashes(data, off) if values is None else word_hashes(data, off, values)
    del data
    to = np.cumsum(counts)
    frm = to - counts
    if len(h) < window:
        return none
    w, g = roll(h, window), roll(h, anchor)
    # Windows that stay inside one text.
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, np.maximum(frm, to - window + 1), 1)
    np.add.at(edge, to, -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(w)] == 0)
    if not len(at):
        return none
    best, off_best = g[: len(w)].copy(), np.zeros(len(w), np.uint8)
    for j in range(1, window - anchor + 1):
        less = g[j : j + len(w)] < best
        best[less] = g[j : j + len(w)][less]
        off_best[less] = j
    wv = w[at]
    doc = np.repeat(np.arange(len(counts)), counts)[at]
    place = np.empty(len(at), seen.at.dtype)
    place["k"], place["th"], place["start"] = ids[doc], ths[doc], at - frm[doc]
    by = np.argsort(wv, kind="stable")
    twice = wv[by[1:]] == wv[by[:-1]]
    again, source = np.zeros(len(at), bool), np.zeros(len(at), place.dtype)
    hit, old = seen.later(wv, place)
    again[hit], source[hit] = True, old
    again[by[1:][twice]], source[by[1:][twice]] = True, place[by[:-1][twice]]
    lead = by[:-1][twice]
    lead = lead[~again[lead]]
    seen.add(wv[lead], place[lead])

    rep = np.flatnonzero(again)
    spans = _spans_of(place[rep], source[rep], (np.diff(at[rep]) != 1) | (np.diff(doc[rep]) != 0))

    keep = np.flatnonzero(~again)
    if not len(keep):
        return spans, *none[1:]
    i = at[keep]
    anchor_at = i + off_best[i]
    a, n = _runs((np.diff(i) != 1) | (np.diff(anchor_at) != 0))
    rec = np.empty(len(a), _SUFFIX)
    rec["key"] = best[i[a]]
    for c in ("k", "th", "start"):
        rec[c] = place[keep[a]][c]
    rec["off"], rec["n"] = off_best[i[a]], n
    return spans, rec, w[i]


def _suffixes_of(chunk: pa.RecordBatch, n_groups: int, window: int, anchor: int, seen: _Seen, heavy: np.ndarray, salt: int = 0) -> Iterator[tuple[int, bytes]]:
    """The suffixes of a chunk's texts by group (and, as group -1, the repeats within the chunk)."""
    spans, rec, edges = _records(chunk, window, anchor, seen, salt)
    if len(spans):
        yield -1, spans.tobytes()
    if not len(rec):
        return
    group = _part(rec["key"], n_groups)
    if len(heavy):
        split = np.isin(_part(rec["key"], n_groups * FINER), heavy)
        if split.any():
            # Each window below a heavy prefix becomes a suffix of its own.
            item, part = _expand(np.where(split, rec["n"], 1))
            at = (np.cumsum(rec["n"], dtype=np.int64) - rec["n"])[item] + part
            rec, group, split = rec[item], group[item], split[item]
            rec["start"] += part.astype(np.int32)
            rec["off"] -= part.astype(np.uint8)
            rec["n"][split] = 1
            group[split] = _part(rec["key"][split] ^ edges[at[split]], n_groups)
    by = np.argsort(group, kind="stable")
    first = (np.cumsum(rec["n"], dtype=np.int64) - rec["n"])[by]
    rec = rec[by]
    item, part = _expand(rec["n"])
    edges = edges[first[item] + part]
    bounds = np.searchsorted(group[by], np.arange(n_groups + 1))
    ends = np.concatenate([[0], np.cumsum(rec["n"], dtype=np.int64)])
    for b in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[b], bounds[b + 1]
        yield int(b), np.int32(hi - lo).tobytes() + rec[lo:hi].tobytes() + edges[ends[lo] : ends[hi]].tobytes()


def _counts(batches: Iterator[pa.RecordBatch], n_prefixes: int, window: int, anchor: int, salt: int = 0) -> Iterator[pa.RecordBatch]:
    """The windows that this task passes on below each prefix, SEGMENT prefixes a row."""
    seen, n = _Seen(), np.zeros(n_prefixes, np.int64)
    for batch in batches:
        for chunk in chunks(batch, "text", CHUNK_BYTES):
            _, rec, _ = _records(chunk, window, anchor, seen, salt)
            np.add.at(n, _part(rec["key"], n_prefixes), rec["n"])
    starts = range(0, n_prefixes, SEGMENT)
    yield pa.record_batch([pa.array(starts, pa.int64()), pa.array([n[i : i + SEGMENT].tobytes() for i in starts], pa.binary())], names=["start", "n"])


def _heavy(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The prefixes that hold more windows than most, over all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = np.frombuffer(raw, np.int64)
            sums[start] = sums[start] + n if start in sums else n
    for start, n in sums.items():
        yield pa.record_batch([pa.array(start + np.flatnonzero(n > most), pa.int64())], names=["prefix"])


def _suffixes(batches: Iterator[pa.RecordBatch], n_groups: int, window: int, anchor: int, heavy: np.ndarray, salt: int = 0) -> Iterator[pa.RecordBatch]:
    seen, turn = _Seen(), 0
    for batch in batches:
        for chunk in chunks(batch, "text", CHUNK_BYTES):
            out = list(_suffixes_of(chunk, n_groups, window, anchor, seen, heavy, salt))
            if out:
                # Repeats that are settled go to any group; the sign tells them apart.
                turn += 1
                g = [x if x >= 0 else -1 - (turn * 7919) % n_groups for x, _ in out]
                yield pa.record_batch([pa.array(g, pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=_GROUPS)


def _spans_batch(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(spans), 100_000):
        s = spans[i : i + 100_000]
        yield pa.record_batch([pa.array(np.ascontiguousarray(s[c])) for c in _REPEATS.names], schema=_REPEATS)


def _subtree(recs: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """The repeats below the anchors of one group."""
    rec, edge = np.concatenate(recs), np.concatenate(edges)
    by = np.argsort(rec["key"], kind="stable")
    same = rec["key"][by[1:]] == rec["key"][by[:-1]]
    several = np.zeros(len(rec), bool)
    several[by[1:][same]] = True
    several[by[:-1][same]] = True
    ends = np.cumsum(rec["n"], dtype=np.int64)
    pick = np.flatnonzero(several)
    if not len(pick):
        return np.zeros(0, _SPAN)
    rec, frm = rec[pick], ends[pick] - rec["n"][pick]
    item, part = _expand(rec["n"])
    node, off = edge[frm[item] + part], (rec["off"][item] - part).astype(np.uint8)
    key, k, th, start = rec["key"][item], rec["k"][item], rec["th"][item], rec["start"][item] + part.astype(np.int32)
    by = np.lexsort((start, th, k, off, node, key))
    new = np.concatenate([[True], (key[by[1:]] != key[by[:-1]]) | (node[by[1:]] != node[by[:-1]]) | (off[by[1:]] != off[by[:-1]])])
    first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    place = np.empty(len(k), [("k", "<i8"), ("th", "<i4"), ("start", "<i4")])
    place["k"], place["th"], place["start"] = k, th, start
    repeated = (k[by] != k[first]) | (th[by] != th[first]) | (start[by] != start[first])
    again, source = by[repeated], first[repeated]
    order = np.argsort(again)
    again, source = again[order], source[order]
    return _spans_of(place[again], place[source], (np.diff(again) != 1) | (np.diff(item[again]) != 0))


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if g < 0:
                yield from _spans_batch(np.frombuffer(raw, _SPAN))
                continue
            n = int(np.frombuffer(raw, np.int32, 1)[0])
            recs, edges = groups.setdefault(g, ([], []))
            recs.append(np.frombuffer(raw, _SUFFIX, n, 4))
            edges.append(np.frombuffer(raw, np.uint64, offset=4 + n * _SUFFIX.itemsize))
    while groups:
        yield from _spans_batch(_subtree(*groups.pop(next(iter(groups)))))


def _digest(words: list[bytes], start: int, n: int, window: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n + window - 1]), digest_size=16).digest()


_CUT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """The texts without their repeats, and the digests of the repeats' words and of those that others repeat, by where these start."""
    checks_of = pa.list_(pa.struct([("k", pa.int64()), ("th", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("d", pa.binary())]))
    for batch in batches:
        ids, words_n, gone_n, kept, checks = [], [], [], [], []
        texts, marks = batch.column("text"), batch.column("marks")
        own = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "k", "th")], strict=True)
        for i, (doc_id, k, th) in enumerate(own):
            words = texts[i].as_py().encode().split()
            gone, total, found = 0, len(words), []
            if marks[i].is_valid:
                edge = np.zeros(total + 1, np.int32)
                for m in marks[i].as_py():
                    at, n = m["start"], m["n"]
                    if m["k0"] is None:  # asked for by another occurrence
                        found.append({"k": k, "th": th, "start": at, "n": n, "d": _digest(words, at, n, window)})
                    else:
                        edge[min(at, total)] += 1
                        edge[min(at + n + window - 1, total)] -= 1
                        found.append({"k": m["k0"], "th": m["th0"], "start": m["start0"], "n": n, "d": _digest(words, at, n, window)})
                stay = np.cumsum(edge[:total]) == 0
                gone = total - int(stay.sum())
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            left = b" ".join(words)
            ids.append(doc_id)
            words_n.append(total)
            gone_n.append(gone)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            checks.append(found)
        cols = [pa.array(ids, pa.int64()), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.string()), pa.array(checks, checks_of)]
        yield pa.record_batch(cols, names=["doc_id", "n_words", "n_removed", "kept", "checks"])


def repeats(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, salt: int = 0) -> DataFrame:
    """(k, th, start, n, k0, th0, start0): n windows from word start on that occur earlier too, from word start0 of a text on."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(partitions(texts.sparkSession), -(-n_bytes // GROUP_BYTES))
    rows, parts = texts.select("k", "th", "text"), SPREAD * n_groups
    counts = rows.mapInArrow(lambda it: frugal(_counts(it, parts * FINER, window, anchor, salt)), "start long, n binary")
    most = MOST_WINDOWS
    many = counts.repartition(partitions(texts.sparkSession), "start").mapInArrow(lambda it: _heavy(it, most), "prefix long").collect()
    heavy = np.array([r["prefix"] for r in many], np.int64)
    suffixes = rows.mapInArrow(lambda it: frugal(_suffixes(it, parts, window, anchor, heavy, salt)), "g int, suffixes binary")
    dealt = suffixes.repartition(n_groups, F.when(F.col("g") < 0, -1 - F.col("g")).otherwise(F.col("g")))
    return dealt.mapInArrow(lambda it: frugal(_repeats(it)), "k long, th int, start int, n int, k0 long, th0 int, start0 int")


def _once(docs: DataFrame, window: int, anchor: int, digest: bool, salt: int) -> DataFrame:
    """The result under one set of hash values, with the digests to verify it by; written."""
    texts = doc_texts(docs).select(
        "doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("k"), F.shiftright(F.xxhash64("text", *[F.lit(salt)] * bool(salt)), 32).cast("int").alias("th"), "text"
    )
    found = written(repeats(texts, window, anchor, salt))
    # A passage that many texts repeat is asked for once.
    asked = found.select(F.col("k0").alias("k"), F.col("th0").alias("th"), F.col("start0").alias("start"), "n").distinct()
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("k0", "long"), ("th0", "int"), ("start0", "int"))]
    marks = found.unionByName(asked.select("*", *none)).groupBy("k", "th").agg(F.collect_list(F.struct("start", "n", "k0", "th0", "start0")).alias("marks"))
    joined = texts.join(marks, ["k", "th"], "left").select("doc_id", "k", "th", "text", "marks")
    out = written(joined.mapInArrow(lambda it: frugal(_cut(it, window, digest)), f"{_CUT}, checks array<struct<{_CHECK.replace(' ', ':').replace(',:', ',')}>>"))
    forget(found)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words of repeated windows.

    kept is the remaining words joined by one space, or with digest its SHA-256.
    """
    if not 1 <= anchor <= window <= 250:
        raise ValueError("anchor must be at most window, and window at most 250")
    for salt in range(TRIES):
        out = _once(docs, window, anchor, digest, salt)
        each = out.select(F.explode("checks").alias("c")).select("c.*").groupBy("k", "th", "start", "n")
        wrong = each.agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least <> most").limit(1).count()
        if not wrong:
            return out.drop("checks")
        forget(out)
    raise RuntimeError("different words have equal hashes under every set of values")
