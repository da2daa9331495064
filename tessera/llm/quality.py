"""Quality rules: a threshold table compiled into one projection.

``measure`` adds the measures of each text as native expressions, and
``verdict`` turns a table of thresholds into one boolean column. There is no
shuffle: a row's result depends on that row alone, so a hot source costs no
more than its share.

Defined cases: a null or empty text, or one of white space only, has no words,
every count 0 and is rejected (n_words < 20). Texts are measured whole, whatever
their length; a measure that equals a threshold passes. Repeated rows each get a
row; a null doc_id is kept; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, let, sql

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to a in is that for it as was with be by on not he are at from or this have an "
    "le la les de des du et un une en que qui dans pour pas sur au avec est par "
    "der die das und zu den von mit ist nicht auf ein eine im dem sich auch für "
    "el los las y del se con una su al lo como más pero no".split()
)
#: As they stand in a text: in lower case, with a capital, in capitals.
STOP_FORMS = tuple(sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}))


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; texts of under min_words pass."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 20


#: The thresholds of production.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("exclamation_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_ratio", 0.03, None, 50),
)

#: Each measure is a quotient of two counts; none if the second is 0.
_MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "exclamation_ratio": ("n_exclaims", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_ratio": ("n_stop", "n_words"),
}


def _repeat_words(window: int) -> str:
    """SQL for the words in windows that the text holds twice or more."""
    hashes = f"transform(sequence(1, size(words) - {window - 1}), i -> xxhash64(slice(words, i, {window})))"
    # Equal hashes stand side by side once sorted; a window is repeated if a neighbour's hash is its own.
    starts = let(
        "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))",
        "s",
        "array_sort(filter(transform(s, (x, k) -> if(x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h, x.i, null)), x -> x IS NOT NULL))",
    )
    covered = let(
        starts,
        "p",
        f"aggregate(transform(p, (x, k) -> least({window}, coalesce(get(p, k + 1) - x, {window}))), 0, (a, x) -> a + x)",
    )
    found = let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0, {covered})")
    return f"if(size(words) < {window + 1}, 0, {found})"


def measure(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id with the measures of each text."""
    spaces = r"' \t\n\u000b\u000c\r'"
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS)
    split = doc_texts(docs).select(
        "doc_id",
        "text",
        F.length("text").alias("n_chars"),
        sql(f"btrim(text, {spaces})").alias("bare"),
        sql(r"filter(split(text, '\n'), x -> x RLIKE '[^ \t-\r]')").alias("lines"),
    ).select(
        "doc_id",
        "text",
        "lines",
        sql(r"if(bare = '', cast(array() AS array<string>), split(bare, '[ \t-\r]+'))").alias("words"),
    )
    return split.select(
        "doc_id",
        sql("cast(size(words) AS bigint)").alias("n_words"),
        sql(f"cast(length(translate(text, {spaces}, '')) AS bigint)").alias("word_chars"),
        sql(f"cast(length(text) - length(translate(text, '{SYMBOLS}', '')) AS bigint)").alias("n_symbols"),
        sql("cast(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        sql(f"cast({_repeat_words(window)} AS bigint)").alias("n_repeat_words"),
        sql("cast(size(lines) AS bigint)").alias("n_lines"),
        sql("cast(length(text) - length(replace(text, '!', '')) AS bigint)").alias("n_exclaims"),
        sql(f"cast(size(filter(words, w -> w IN ({stop}))) AS bigint)").alias("n_stop"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the measures pass every rule of the table."""
    passed = F.lit(True)
    for r in rules:
        value = F.try_divide(*_MEASURES[r.measure])
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (value >= r.low)
        if r.high is not None:
            inside = inside & (value <= r.high)
        passed = passed & ((F.col("n_words") < r.min_words) | F.coalesce(inside, F.lit(False)))
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, window: int = WINDOW) -> DataFrame:
    """Measures, base_failed and kept for each document."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measure(docs, window).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
        "n_lines", "n_exclaims", "n_stop",
    )
