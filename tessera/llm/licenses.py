"""License scans: ordered signature rules over a normal form of the text.

A text is reduced to its words (lower-cased runs of 0-9, a-z and characters
past ASCII), joined by one space, so a rule is a plain regex over words and its
place is a word index. Rules are written one by one in ``license_rules``; each
has a keyword that begins a word of all its matches, a first gate finds the texts
that hold any of them, and a rule is tried where its keyword stands, so most
texts meet only one cheap test.

Overlaps: rules have a priority (base phrases first, then the order of the
table). A detection inside the interval of another one of higher priority, or of
equal priority and greater length, is suppressed. Base phrases are never
suppressed. Places are running sums in blocks, and suppression looks back over
the length of the longest detection in sorted order, so a text of many matches
costs little more than their number.

Only native expressions; no shuffle, so skew of any column is harmless.

Defined cases: a null or empty text has 0 words, no place (first and last word
null), empty labels and score 0. Texts are scanned whole, whatever their length.
Equal detections of one rule count once; of rules with the same interval the
earlier one wins. Repeated rows each get a row; a null doc_id is kept; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, let, running, sql
from .license_rules import TABLE

#: Fixed phrases with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    """A lower priority number wins; keyword: a string that begins a word of each match."""

    priority: int
    label: str
    keyword: str
    regex: str
    score: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """The ordered rules of the table."""
    lines = [line for line in TABLE.splitlines() if line and not line.startswith("#")]
    fields = [[x.strip() for x in line.split(" | ", 3)] for line in lines]
    return tuple(Rule(k, label, keyword, regex, float(score)) for k, (label, keyword, score, regex) in enumerate(fields, 1))


def _gate() -> str:
    """A regex that finds the start of a word which every rule and base phrase holds one of.

    It tries its words after a separator only, grouped by first letter, so most
    characters of a text cost one class test.
    """
    keys = {r.keyword for r in rules()} | {"licen", "cc"}  # those of the base phrases
    keys = {k for k in keys if not any(k != o and k.startswith(o) for o in keys)}
    by_letter: dict[str, list[str]] = {}
    for k in sorted(keys):
        by_letter.setdefault(k[0], []).append(k[1:])
    words = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return r"(?:^|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])(?:" + words + ")"


def _words_in(x: str) -> str:
    """SQL for the number of words of a part of the normal form: half its spaces."""
    return f"cast(length({x}) - length(replace({x}, ' ', '')) AS bigint)"


def _places(regex: str, of: str = "norm") -> str:
    """SQL for the (start, n) word places of a regex, itself SQL, over whole words.

    Words stand as ' w1  w2 ' (each between spaces of its own), so neighbouring
    matches share no character. What split() leaves between the matches tells
    where they start.
    """
    return let(
        f"split({of}, {regex}, -1)",
        "p",
        let(
            f"regexp_extract_all({of}, {regex}, 0)",
            "m",
            let(
                running(f"transform(m, (x, i) -> {_words_in('p[i]')} + {_words_in('x')})"),
                "e",
                f"transform(m, (x, i) -> struct((e[i] - {_words_in('x')}) div 2 AS start, {_words_in('x')} div 2 AS n))",
            ),
        ),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def doubled(regex: str) -> str:
    """A regex written with single spaces, for words that stand two spaces apart."""
    return regex.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    every = rules()
    gate = _gate()
    between = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    # split() and not regexp_count(): that one copies the text at each match.
    count = let(
        f"split(text, '{between}', -1)",
        "w",
        "size(w) - if(w[0] = '', 1, 0) - if(size(w) > 1 AND element_at(w, -1) = '', 1, 0)",
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = doc_texts(docs).select(
        "doc_id",
        sql(f"cast({count} AS bigint)").alias("n_words"),
        sql(
            f"if(text RLIKE '(?i){gate}', concat(' ', array_join(filter(split("
            f"translate(text, '{upper}', '{lower}'), '{between}'), w -> w != ''), '  '), ' '), '')"
        ).alias("norm"),
    )
    phrases = [
        f"transform({_places_overlapping(p)}, s -> struct(s AS start, -(s + {p.count(' ') + 1}) AS back, 0 AS priority, '{label}' AS label, 1.0D AS score))"
        for p, label in BASE
    ]
    found = base.select(
        "*", sql(f"if(norm = '', cast(array() AS array<{_DETECTION}>), concat({', '.join(phrases)}))").alias("base")
    )
    # The table is one constant, so the plan does not grow with it: a text tries the rules whose keyword it holds.
    keywords = "array(" + ", ".join(_quoted(k) for k in sorted({r.keyword for r in every})) + ")"
    table = "array(" + ", ".join(
        f"struct({r.priority} AS priority, {_quoted(r.label)} AS label, {_quoted(r.keyword)} AS keyword, {_quoted(f' {doubled(r.regex)} ')} AS regex, {r.score}D AS score)" for r in every
    ) + ")"
    held = let(f"filter({keywords}, k -> contains(norm, k))", "kw", f"filter({table}, r -> array_contains(kw, r.keyword) AND norm RLIKE r.regex)")
    more = (
        f"flatten(transform({held}, r -> transform({_places('r.regex')}, x -> "
        "struct(x.start AS start, -(x.start + x.n) AS back, r.priority AS priority, r.label AS label, r.score AS score))))"
    )
    found = found.select("doc_id", "n_words", "base", sql(f"if(norm = '', base, concat(base, {more}))").alias("every"))
    # Sorted by start and then by falling end, whatever holds a detection stands before it, and begins at most as many
    # words before it as the longest detection has; where those begin is found by steps of halving length.
    steps = "array(" + ", ".join(str(1 << k) for k in range(30, -1, -1)) + ")"
    swept = let(
        "array_sort(every)",
        "s",
        let(
            "coalesce(array_max(transform(s, d -> -d.back - d.start)), 0L)",
            "w",
            "transform(filter(transform(s, (d, i) -> struct(d AS d, i AS i)), x -> (x.i = 0 OR x.d <> s[x.i - 1]) AND (x.d.priority = 0 OR NOT exists("
            f"slice(s, aggregate({steps}, x.i, (j, k) -> if(j >= k AND s[j - k].start >= x.d.start - w, j - k, j)) + 1, "
            f"x.i - aggregate({steps}, x.i, (j, k) -> if(j >= k AND s[j - k].start >= x.d.start - w, j - k, j))), o -> "
            "o.back <= x.d.back AND (o.priority < x.d.priority OR (o.priority = x.d.priority AND o.start + o.back < x.d.start + x.d.back))))), "
            "x -> struct(x.d.priority AS priority, x.d.start AS start, -x.d.back AS `end`, x.d.label AS label, x.d.score AS score))",
        ),
    )
    kept = found.select("doc_id", "n_words", "base", sql(swept).alias("detections"))
    return kept.select(
        "doc_id",
        "n_words",
        sql("cast(size(base) AS bigint)").alias("n_base"),
        sql("array_min(transform(base, d -> d.start))").alias("first_word"),
        sql("array_max(transform(base, d -> d.start))").alias("last_word"),
        sql("array_join(array_sort(array_distinct(transform(base, d -> d.label))), ',')").alias("base_labels"),
        sql("array_join(array_sort(array_distinct(transform(detections, d -> d.label))), ',')").alias("labels"),
        sql("coalesce(array_max(transform(detections, d -> d.score)), 0.0D)").alias("score"),
        "detections",
    )


_DETECTION = "struct<start:bigint,back:bigint,priority:int,label:string,score:double>"


def _places_overlapping(phrase: str) -> str:
    """SQL for the word indices where a phrase's words stand, overlaps included."""
    first, *rest = phrase.split(" ")
    ahead = " " + first + " " + f"(?= {'  '.join(rest)} )"
    return let(
        f"split(norm, '{ahead}', -1)",
        "p",
        let(running(f"transform(p, x -> {_words_in('x')})"), "e", "transform(slice(e, 1, size(e) - 1), (x, i) -> x div 2 + i)"),
    )
