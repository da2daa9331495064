"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's paragraphs are its lines; each is cut after sentences and after every
fourth word into pieces, the leaves. A section is a run of paragraphs that ends
with a blank one, or one whose hash starts with 0 to 3: bounds that depend on
content alone, so an insertion moves no later section. Pieces, paragraphs and
sections hash to MD5, the root is the SHA-256 of the sections. Nothing is
dropped on the way down, so equal roots mean equal texts.

A fingerprint reads ``root|section:paragraphs,...|leaves of paragraph,...``:
roots test equality, and ``differences`` locates edits by descending into
branches that differ: from the roots to the sections that the other tree lacks,
and from these to their paragraphs that the other's differing sections lack.
Likeness is 1 for equal roots, else Dice's coefficient of the leaves, each
counted as often as it occurs.

Only native expressions. One document's expressions depend on its own text;
``with_next`` pairs neighbours by doc_id with a single shuffle.

Defined cases: null and empty texts are one empty paragraph; two such texts are
alike 1. Texts are taken whole, whatever their length. A null doc_id counts as
the smallest. Rows of one doc_id count as one document, with the least of their
texts, when they are another one's next; each still gets its own row. The only
document is its own next. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, let, running, sql

PIECE_WORDS = 4
_EMPTY = "d41d8cd98f00b204e9800998ecf8427e"  # MD5 of the empty string
#: Documents that one window holds, and the most ranges they are dealt into.
RANGE_ROWS = 1024
MOST_RANGES = 4096
_NULL_ID = -(2**63)
#: Lengths of the steps in which the begin of a run is looked for, the longest first.
_STEPS = "array(" + ", ".join(str(1 << k) for k in range(20, -1, -1)) + ")"


def tree(text: str) -> Column:
    """struct(fingerprint, leaves) of a text column; leaves are not empty, and numbered where they repeat."""
    marked = f"regexp_replace(regexp_replace(p, '([.!?] +)', '$1\\u0001'), '((?:[^ \\u0001]+ +){{{PIECE_WORDS}}})', '$1\\u0001')"
    leaves = f"transform(split({text}, '\\n', -1), p -> transform(split({marked}, '\\u0001', -1), x -> md5(x)))"
    paragraphs = "array_join(transform(t, l -> concat(',', md5(array_join(l, '')), '.')), '')"
    sections = f"filter(split(regexp_replace(s, '(,[0-3][0-9a-f]{{31}}[.]|,{_EMPTY}[.])', '$1;'), ';'), x -> x != '')"
    # In sorted order equal leaves stand together. Where a run begins is found by steps of halving length, so that the
    # second of two equal leaves differs from the first, and sets of leaves count repeats.
    first = f"aggregate({_STEPS}, k, (i, d) -> if(i >= d AND get(s, i - d) = x, i - d, i))"
    numbered = let(
        f"array_sort(transform(filter(flatten(t), x -> x != '{_EMPTY}'), x -> substr(x, 1, 8)))",
        "s",
        f"transform(s, (x, k) -> if(k > 0 AND get(s, k - 1) = x, concat(x, ':', cast(k - {first} AS string)), x))",
    )
    out = (
        "named_struct('fingerprint', concat("
        "sha2(array_join(transform(c, x -> md5(x)), ''), 256), '|', "
        "array_join(transform(c, x -> concat(substr(md5(x), 1, 16), ':', cast(length(x) - length(replace(x, ',', '')) AS string))), ','), '|', "
        "array_join(transform(t, l -> array_join(transform(l, x -> substr(x, 1, 8)), '')), ',')), "
        f"'leaves', {numbered})"
    )
    return sql(let(leaves, "t", let(paragraphs, "s", let(sections, "c", out))))


def likeness(a: str, b: str) -> Column:
    """Of two columns made by tree()."""
    return sql(
        f"if(substr({a}.fingerprint, 1, 64) = substr({b}.fingerprint, 1, 64), 1.0D, "
        f"if(size({a}.leaves) + size({b}.leaves) = 0, 0.0D, "
        f"2.0D * size(array_intersect({a}.leaves, {b}.leaves)) / (size({a}.leaves) + size({b}.leaves))))"
    )


def _lacking(a: str, b: str) -> str:
    """SQL for the ascending positions of the strings in array a that array b does not hold.

    Sorted together, equal strings stand side by side, those of b first; where they begin is found by steps of halving length.
    """
    both = f"array_sort(concat(transform({b}, x -> struct(x AS x, 0 AS side, -1 AS i)), transform({a}, (x, i) -> struct(x AS x, 1 AS side, i AS i))))"
    first = f"aggregate({_STEPS}, z.k, (j, d) -> if(j >= d AND get(lk, j - d).x = z.y.x, j - d, j))"
    numbered = "transform(lk, (y, k) -> struct(y AS y, k AS k))"
    return let(both, "lk", f"array_sort(transform(filter({numbered}, z -> z.y.side = 1 AND lk[{first}].side = 1), z -> z.y.i))")


def differences(a: str, b: str) -> Column:
    """struct(sections, paragraphs): positions in the first fingerprint of the branches that the second lacks.

    Only paragraphs of differing sections are compared, with those of the other's differing sections.
    """

    def paragraphs(of: str, sections: str, differing: str) -> str:
        counts = f"transform({sections}, x -> cast(split_part(x, ':', 2) AS bigint))"
        ends = let(running(counts), "pe", f"flatten(transform({differing}, i -> sequence(cast(pe[i] - cast(split_part({sections}[i], ':', 2) AS int) AS int), cast(pe[i] - 1 AS int))))")
        return let(f"split({of}[2], ',', -1)", "ps", let(ends, "pi", "transform(pi, i -> struct(i AS i, ps[i] AS p))"))

    none = "cast(array() AS array<int>)"
    found = let(
        paragraphs("fa", "sa", "da"),
        "qa",
        let(
            paragraphs("fb", "sb", "db"),
            "qb",
            f"named_struct('sections', da, 'paragraphs', transform({_lacking('transform(qa, x -> x.p)', 'transform(qb, x -> x.p)')}, i -> qa[i].i))",
        ),
    )
    descent = let(
        "split(fa[1], ',', -1)",
        "sa",
        let("split(fb[1], ',', -1)", "sb", let(_lacking("sa", "sb"), "da", let(_lacking("sb", "sa"), "db", found))),
    )
    whole = let(f"split({a}, '[|]', -1)", "fa", let(f"split({b}, '[|]', -1)", "fb", f"if(fa[0] = fb[0], named_struct('sections', {none}, 'paragraphs', {none}), {descent})"))
    return sql(whole)


def _range_of(bounds: list[int]) -> Column:
    """The number of bounds that k reaches, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = "array(" + ", ".join(f"{b}L" if b > _NULL_ID else "-9223372036854775807L - 1L" for b in bounds) + ")"
    coarse = "array(" + ", ".join(f"{b}L" if b > _NULL_ID else "-9223372036854775807L - 1L" for b in bounds[step - 1 :: step]) + ")"
    found = let(f"size(filter({coarse}, b -> b <= k)) * {step}", "c", f"c + size(filter(slice({every}, c + 1, {step}), b -> b <= k))")
    return sql(found)


def with_next(texts: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the largest smaller doc_id, after the smallest that of the largest.

    doc_id is cut into ranges of about RANGE_ROWS rows by quantiles. Each range
    also gets the top document of the range below it (the lowest, that of the
    highest), so a window over one range sees all its neighbours.
    """
    keyed = texts.withColumn("k", F.coalesce("doc_id", F.lit(_NULL_ID)))
    n = keyed.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(keyed.agg(F.percentile_approx("k", cuts, 4 * MOST_RANGES)).first()[0]))
    keyed = keyed.withColumn("r", _range_of(bounds))
    tops = sorted((row["r"], row["top"]) for row in keyed.groupBy("r").agg(F.max("k").alias("top")).collect())
    to = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    rows = keyed.select("r", F.lit(0).alias("guest"), sql("~k").alias("down"), "text", "doc_id")
    if to:
        guests = keyed.where(F.col("k").isin(list(to))).groupBy("k").agg(F.min("text").alias("text"))
        target = F.element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), F.col("k"))
        rows = rows.unionByName(guests.select(target.alias("r"), F.lit(1).alias("guest"), sql("~k").alias("down"), "text", F.lit(None).cast("long").alias("doc_id")))
    order = ["guest", "down", "text"]
    after = F.lead(F.struct("text")).over(Window.partitionBy("r").orderBy(*order))
    last = F.last("after").over(Window.partitionBy("r", "guest", "down").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    paired = rows.withColumn("after", after).withColumn("after", last)
    return paired.where("guest = 0").select("doc_id", "text", F.col("after.text").alias("next_text"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and leaves of each document."""
    return doc_texts(docs).select("doc_id", tree("text").alias("t")).select("doc_id", "t.fingerprint", "t.leaves")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, and how many sections and paragraphs the edit changed.

    Edited: the last floor(n_chars / 2) code points make way for the first as
    many, or all, of the next document's text.
    """
    paired = with_next(doc_texts(docs)).withColumn("n_chars", F.length("text").cast("long"))
    edited = paired.withColumn("edited", sql("concat(left(text, cast(n_chars - n_chars div 2 AS int)), left(next_text, cast(n_chars div 2 AS int)))"))
    trees = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        tree("text").alias("own"), tree("edited").alias("edit"), tree("next_text").alias("follow"),
    )
    return trees.select(
        "doc_id", "n_chars", "edited_sha256",
        F.col("own.fingerprint").alias("fingerprint"), F.col("edit.fingerprint").alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"), likeness("own", "follow").alias("near_next"),
        differences("own.fingerprint", "edit.fingerprint").alias("changed"),
    ).withColumns({f"changed_{x}": F.size(f"changed.{x}").cast("long") for x in ("sections", "paragraphs")}).drop("changed")
