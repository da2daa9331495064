"""SentencePiece encoding and decoding over a relational lattice.

A text is a row of words: each run of spaces, written as U+2581, with what
follows up to the next space; one more space leads. No piece holds a space
after another character, so words are encoded one by one.

The lattice of the frequent words is built in Spark: substrings up to the
longest piece are exploded, equi-joined to the piece table and grouped by word,
and a fold with ``aggregate`` over the edges in order of their ends keeps the
best edge into each place (Viterbi), which is read back from the end.

The piece models at hand are byte-pair merges, whose scores are the order of
merges and not log probabilities: a path of greatest score sum is no encoding
of theirs. So a step of the fold scores 0 if merging the two pieces' characters
gives just these two pieces, else minus infinity. Exactly one path has a finite
score, and it is the encoding by merges. A character without piece is an edge of
its own and becomes its UTF-8 bytes' pieces.

The frequent words are at most FREQUENT, so their table has a size bound and is
sent to the executors. All other words are exact too: the same lattice and
Viterbi run for them where they stand: in numpy over the
new words of a chunk of texts at once (``lattice``), and word by word for words
of over 64 characters.

Defined cases: null and empty texts have no pieces. Texts and words of any length
are encoded whole. Texts that hold U+2581 itself decode to spaces in its place, as
in the format. Of pairs that merge alike the leftmost merges first; words of like
counts enter the frequent ones together or not at all. Repeated rows each get a
row; a null doc_id is kept; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, frugal, let, partitions, pick, sql, written
from .lattice import Lattice
from .wordhash import chunks

SPACE = "▁"
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
FREQUENT = 100_000
#: Words that a task remembers at most, and pairs and runs.
_WORDS = 400_000
_CACHE = 150_000
#: Bits that tell, by hash, which words a task met before: only those are worth remembering.
_MET = 1 << 23
_CHUNK_BYTES = 2 << 20
#: Words that a task counts before it passes their counts on.
_COUNTED = 200_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def merged(text: str, rank: dict[str, int]) -> list[str]:
    """A text's characters after merging, again and again, the neighbours of least rank, leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def split_words(text: str, lines: bool) -> list[str]:
    """The words of a text that is not empty, in short form: see spaced().

    With lines a word also ends before a line feed, for models without a piece that holds one.
    """
    text = text.replace(SPACE, " ")
    words = (text.replace("\n", " \n") if lines else text).split(" ")
    if "" not in words:
        return words
    out, lead = [], 0
    for w in words[:-1]:
        if w:
            out.append(" " * lead + w)
            lead = 0
        else:
            lead += 1
    return [*out, " " * lead + words[-1]]


def spaced(word: str, lines: bool) -> str:
    """A word with its spaces written out; the short form leaves out one before anything but a line feed."""
    bare = word.lstrip(" ")
    return SPACE * (len(word) - len(bare) + (not (lines and bare[:1] == "\n"))) + bare


@dataclass
class Pieces:
    """The piece table: id and rank of each piece, ids of the 256 bytes, and what each id decodes to."""

    ids: dict[str, int]
    rank: dict[str, int]
    byte_ids: list[int]
    out: list[bytes]
    longest: int
    whole: frozenset[str] = frozenset()
    #: Ends of pieces, with 1 for those that are pieces themselves; pairs of characters that some piece holds.
    kinds: dict[str, int] = field(default_factory=dict)
    inside: frozenset[str] = frozenset()
    #: The piece of each id ('' for bytes), and each piece's id as bytes.
    names: list[str] = field(default_factory=list)
    lines: bool = True
    id_bytes: dict[str, bytes] = field(default_factory=dict)
    fits: dict[str, dict[str, bool]] = field(default_factory=dict)
    n_fits: int = 0
    runs: dict[str, bytes] = field(default_factory=dict)
    #: Tells tables apart.
    key: str = ""

    def __getstate__(self) -> dict:
        return {**self.__dict__, "fits": {}, "n_fits": 0, "runs": {}}

    def follows(self, left: str, right: str) -> bool:
        """True if left and right stay apart when their characters are merged."""
        if self.n_fits > _CACHE:
            self.fits.clear()
            self.n_fits = 0
        known = self.fits.setdefault(left, {})
        found = known.get(right)
        if found is None:
            found = known[right] = merged(left + right, self.rank) == [left, right]
            self.n_fits += 1
        return found

    def _viterbi(self, word: str) -> bytes:
        """The path through the lattice of characters that pieces may join."""
        n, kinds, fits = len(word), self.kinds, self.fits
        last, back = [""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            start = end - 1
            piece = word[start]
            kind = kinds.get(piece, 1)  # a character is an edge, with a piece or without
            while True:
                if kind:
                    if start == 0:
                        break
                    known = fits.get(last[start])
                    good = known.get(piece) if known is not None else None
                    if good is None:
                        good = self.follows(last[start], piece)
                    if good:  # no other edge into this place has a finite score
                        break
                start -= 1
                piece = word[start:end]
                kind = kinds[piece]  # a longer edge must end here: merging always leaves one that does
            last[end], back[end] = piece, start
        path, at = [], n
        while at:
            path.append(last[at])
            at = back[at]
        ids = self.id_bytes
        return b"".join([ids[p] if p in ids else self._of_bytes(p) for p in reversed(path)])

    def _of_bytes(self, character: str) -> bytes:
        return np.array([self.byte_ids[b] for b in character.encode()], np.int32).tobytes()

    def encode_word(self, word: str) -> bytes:
        """The ids of a word as bytes of int32: the paths of its runs, cut where no piece joins two characters."""
        if word[1:].isalpha():
            return self._viterbi(word)
        inside, cuts = self.inside, [0]
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                cuts.append(i)
        if len(cuts) == 1:
            return self._viterbi(word)
        runs, out = self.runs, []
        if len(runs) > _CACHE:
            runs.clear()
        for i, j in zip(cuts, [*cuts[1:], len(word)], strict=True):
            run = word[i:j]
            ids = runs.get(run)
            if ids is None:
                ids = runs[run] = self._viterbi(run)
            out.append(ids)
        return b"".join(out)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words as bytes of int32: all lattices at once, but for the words that need a walk of their own."""
        return [self.encode_word(w) if ids is None else ids for w, ids in zip(words, _lattice(self).encode(words), strict=True)]

    def encode_texts(self, texts: list[str], known: dict[str, bytes], met: bytearray | None = None) -> list[np.ndarray]:
        """The ids of texts; known: those of words, as bytes of int32, to which it adds words met before."""
        words = [split_words(t, self.lines) if t else [] for t in texts]
        found = [list(map(known.get, w)) for w in words]
        gaps = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = list(dict.fromkeys([w[i] for w, gap in zip(words, gaps, strict=True) for i in gap]))
        ids_of = dict(zip(new, self.encode_words([SPACE + w if w[:1] > " " else spaced(w, self.lines) for w in new]), strict=True))
        if met is not None:
            for w, ids in ids_of.items():
                bit = hash(w) % _MET
                if met[bit >> 3] >> (bit & 7) & 1:
                    known[w] = ids
                else:
                    met[bit >> 3] |= 1 << (bit & 7)
        for w, f, gap in zip(words, found, gaps, strict=True):
            for i in gap:
                f[i] = ids_of[w[i]]
        return [np.frombuffer(b"".join(f), np.int32) for f in found]

    def encode(self, text: str, known: dict[str, bytes], met: bytearray | None = None) -> np.ndarray:
        """The ids of a text: see encode_texts()."""
        return self.encode_texts([text], known, met)[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


#: Lattices by the key of their table: a worker keeps them from one task to the next.
_LATTICES: dict[str, Lattice] = {}


def _lattice(pieces: Pieces) -> Lattice:
    found = _LATTICES.get(pieces.key)
    if found is None:
        while len(_LATTICES) > 1:
            del _LATTICES[next(iter(_LATTICES))]
        rank = pieces.rank
        found = _LATTICES[pieces.key] = Lattice(pieces.kinds, pieces.ids, pieces.byte_ids, lambda a, b: merged(a + b, rank) == [a, b])
    return found


@lru_cache(maxsize=2)
def load_pieces(path: str = MODEL) -> Pieces:
    """The piece table of a model file (byte-pair merges with byte fallback)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, byte_ids, out = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(_BYTE.fullmatch(piece)[1], 16)
            byte_ids[value] = i
            out.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(b"")
        else:
            ids[piece] = i
            rank[piece] = -model.get_score(i)
            out.append(piece.replace(SPACE, " ").encode())
    made = Pieces(ids, rank, byte_ids, out, max(map(len, ids), default=1))
    # A piece that merging never ends in is no edge of a lattice.
    made.whole = frozenset(p for p in ids if len(p) == 1 or merged(p, rank) == [p])
    by_id = {i: p for p, i in ids.items()}
    made.lines = not any("\n" in p for p in ids)
    made.names = [by_id.get(i, "") for i in range(len(out))]
    made.id_bytes = {p: np.int32(i).tobytes() for p, i in ids.items()}
    made.kinds = {p[i:]: 0 for p in made.whole for i in range(len(p))} | dict.fromkeys(made.whole, 1)
    made.inside = frozenset(p[i : i + 2] for p in ids for i in range(len(p) - 1))
    made.key = hashlib.sha256(repr((byte_ids, [(p, i, rank[p]) for p, i in ids.items()])).encode()).hexdigest()
    return made


def _count(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
        n.clear()
        return out

    for batch in batches:
        for chunk in chunks(batch, "text", _CHUNK_BYTES):
            for t in chunk.column("text").to_pylist():
                if t:
                    n.update(split_words(t, lines))
            if len(n) > _COUNTED:
                yield passed_on()
    yield passed_on()


def frequent_words(texts: DataFrame, lines: bool = True, most: int = FREQUENT) -> DataFrame:
    """(word) of words as split_words() gives them that occur often: at most so many, all above some count.

    The count comes from a table of at most 1024 steps of counts, so no task
    sees more words than its share.
    """
    counted = texts.select("text").mapInArrow(lambda it: frugal(_count(it, lines)), "word string, n long").where("length(word) <= 64")
    words = written(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    left, least = most, None
    for r in sorted(words.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["step"]
    return words.where(F.lit(False) if least is None else F.col("step") >= least).select("word")


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id) of the pieces that can be an edge: as many rows as the model has."""
    return spark.createDataFrame([(p, pieces.ids[p]) for p in sorted(pieces.whole)], "piece string, id int")


def _follow(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
        yield batch.filter(pa.array([pieces.follows(a, b) for a, b in pairs], pa.bool_()))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words as split_words() gives them, by the lattice in Spark."""
    spark = words.sparkSession
    implied = "if(startswith(ltrim(word), '\\n'), 0, 1)" if pieces.lines else "1"
    given = words.select("word", sql(f"concat(repeat('{SPACE}', length(word) - length(ltrim(word)) + {implied}), ltrim(word))").alias("w"))
    given = written(given).repartition(partitions(spark), "word")
    ids = _encode_spaced(given.select(F.col("w").alias("word")), pieces)
    return given.withColumnRenamed("w", "spaced").join(ids.withColumnRenamed("word", "spaced"), "spaced").select("word", "ids")


def _encode_spaced(words: DataFrame, pieces: Pieces) -> DataFrame:
    table = F.broadcast(piece_table(words.sparkSession, pieces))
    cut = words.select("word", sql(
        "explode(flatten(transform(sequence(1, length(word)), s -> transform("
        f"sequence(1, least({pieces.longest}, length(word) - s + 1)), n -> struct(s - 1 AS s, s - 1 + n AS e, substr(word, s, n) AS piece)))))"
    ).alias("x")).select("word", "x.*")
    edges = cut.join(table, "piece", "left").where("id IS NOT NULL OR e = s + 1")
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "s", "piece", F.coalesce("id", F.lit(-1)).alias("id")))).alias("edges"))
    steps = written(lattice.select("word", "edges", sql(
        "array_distinct(flatten(transform(edges, a -> transform(filter(edges, b -> b.s = a.e), b -> struct(a.piece AS left, b.piece AS right)))))"
    ).alias("steps")))
    met = steps.select("word", F.explode("steps").alias("p")).select("word", "p.left", "p.right")
    good = met.select("left", "right").distinct().mapInArrow(lambda it: frugal(_follow(it, pieces)), "left string, right string")
    finite = met.join(good, ["left", "right"]).groupBy("word").agg(F.collect_set(F.struct("left", "right")).alias("finite"))
    joined = steps.join(finite, "word", "left").select("word", "edges", sql("coalesce(finite, cast(array() AS array<struct<left:string,right:string>>))").alias("finite"))
    place = "struct<piece:string,id:int,s:int>"
    best = (
        f"aggregate(edges, transform(sequence(0, length(word)), i -> if(i = 0, cast(struct('', -2, 0) AS {place}), cast(null AS {place}))), "
        "(best, x) -> if(best[x.s] IS NULL OR best[x.e] IS NOT NULL OR (x.s > 0 AND NOT array_contains(finite, struct(best[x.s].piece AS left, x.piece AS right))), best, "
        f"transform(best, (b, i) -> if(i = x.e, cast(struct(x.piece, x.id, x.s) AS {place}), b))))"
    )
    back = let(
        best,
        "b",
        f"aggregate(sequence(1, length(word)), cast(struct(length(word), array()) AS struct<at:int,path:array<{place}>>), "
        f"(a, i) -> if(a.at > 0, cast(struct(b[a.at].s, concat(array(b[a.at]), a.path)) AS struct<at:int,path:array<{place}>>), a), a -> a.path)",
    )
    byte_ids = "array(" + ", ".join(map(str, pieces.byte_ids)) + ")"
    of_bytes = f"transform(sequence(0, octet_length(x.piece) - 1), i -> {byte_ids}[cast(conv(substr(hex(encode(x.piece, 'UTF-8')), 2 * i + 1, 2), 16, 10) AS int)])"
    return joined.select("word", sql(f"flatten(transform({back}, x -> if(x.id >= 0, array(x.id), {of_bytes})))").alias("ids"))


def _encode(batches: Iterator[pa.RecordBatch], pieces: Pieces, table: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    known, met = dict(table), bytearray(_MET >> 3)
    for batch in batches:
        for chunk in chunks(batch, "text", _CHUNK_BYTES):
            if len(known) > len(table) + _WORDS:
                known = dict(table)
            texts = chunk.column("text").to_pylist()
            ids = pieces.encode_texts(texts, known, met)
            same = [pieces.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            n = np.array([len(i) for i in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
            yield pa.record_batch([chunk.column("doc_id"), pa.array(n), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])


def _rare(batches: Iterator[pa.RecordBatch], lines: bool, table: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch, "text", _CHUNK_BYTES):
            rows, words = [], []
            for row, text in zip(chunk.column("row").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                found = {w for w in split_words(text, lines) if w not in table} if text else ()
                rows += [row] * len(found)
                words += found
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(words, pa.string())], names=["row", "word"])


def _assembled(batches: Iterator[pa.RecordBatch], pieces: Pieces, table: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, rare in zip(batch.column("text").to_pylist(), batch.column("rare").to_pylist(), strict=True):
            own = {r["word"]: np.array(r["ids"], np.int32).tobytes() for r in rare or ()}
            words = split_words(text, pieces.lines) if text else ()
            out.append(np.frombuffer(b"".join([table[w] if w in table else own[w] for w in words]), np.int32))
        same = [pieces.decode(i) == t for i, t in zip(out, batch.column("text").to_pylist(), strict=True)]
        n = [len(i) for i in out]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([i.tolist() for i in out], pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"]
        )


_ENCODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, model: str = MODEL, most: int = FREQUENT, joined: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding the ids gives the text back) of every document.

    joined: the words that are not among the frequent ones go through the lattice in Spark too, and are joined back by
    document and word. The result is the same; see the README for what either way costs.
    """
    pieces = load_pieces(model)
    texts = doc_texts(docs)
    spark = docs.sparkSession
    rows = encode_words(frequent_words(texts, pieces.lines, most), pieces).collect()  # at most `most` short rows
    table = spark.sparkContext.broadcast({r["word"]: np.array(r["ids"], np.int32).tobytes() for r in rows})
    del rows
    if not joined:
        return texts.mapInArrow(lambda it: frugal(_encode(it, pieces, table.value)), _ENCODED)
    keyed = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    lines = pieces.lines
    rare = written(keyed.select("row", "text").mapInArrow(lambda it: frugal(_rare(it, lines, table.value)), "row long, word string").distinct())
    ids = encode_words(rare.select("word").distinct(), pieces)
    held = rare.join(ids, "word").groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
    back = keyed.join(held, "row", "left").select("doc_id", "text", "rare")
    return back.mapInArrow(lambda it: frugal(_assembled(it, pieces, table.value)), _ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [pieces.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids are the empty text."""
    pieces = load_pieces(model)
    rows = pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: frugal(_decode(it, pieces)), "doc_id long, text string")
