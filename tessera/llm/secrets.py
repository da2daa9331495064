"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: alternatives of
sets of trigrams that any match must hold. The index lists (trigram, text) for
the trigrams that some query names. Queries are answered by joining postings to
the queries' few trigrams and counting: a text is a candidate of an alternative
if all of its trigrams met. Only candidates are verified with the rule's regex;
a rule without mandatory trigrams scans every text.

Postings are never gathered by trigram: they are counted by text, so a trigram
that a third of all texts hold is just that many rows.

Only native expressions on the executors; the queries are derived on the driver
from the rule table alone.

Defined cases: null and empty texts have no spans. Texts are scanned whole,
whatever their length and number of matches. Spans that start alike stand in the
order of the rules. Repeated rows each get a row; a null doc_id is kept; an empty
table gives no rows; other columns are ignored, whatever their names, and kept by
``redact``.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, let, running, sql


# Python's own reading of a regex as a syntax tree: not a public name before or after 3.11, so both are tried.
try:
    K, _parser = importlib.import_module("re._constants"), importlib.import_module("re._parser")
except ModuleNotFoundError:
    K, _parser = importlib.import_module("sre_constants"), importlib.import_module("sre_parse")


@dataclass(frozen=True)
class Rule:
    """kind; regex, in the part that Java, RE2 and Python read alike; least length of a group's text."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = False


#: Base rules, fixed, in their order. For access and hex a least length of 18 and 16 characters is the same
#: as dropping shorter matches, since a match is a whole run. For assign it is not: a match whose value is too
#: short still uses up its characters, so those are dropped afterwards.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
)

#: More kinds, after the base ones in the order of spans.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", any_case=True),
    Rule("url_login", r"[a-z]+://[^/\x20\n:@]+:[^/\x20\n:@]+@"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 16
_BLOCK = 64
Query = frozenset[frozenset[str]]  # alternatives of trigrams that all must stand; {empty set} asks for nothing
_ANY: Query = frozenset([frozenset()])


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _least(alternatives: set[frozenset[str]]) -> Query:
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _and(a: Query, b: Query) -> Query:
    both = _least({x | y for x in a for y in b})
    return both if len(both) <= 4 * _MOST_STRINGS else min(a, b, key=len)


def _set_of(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _walk(items: list) -> tuple[set[str] | None, Query]:
    """Of a sequence: all strings it matches, if few, and what else it asks for."""
    query, run, whole = _ANY, {""}, True

    def end_run() -> None:
        nonlocal query, run, whole
        query, run, whole = _and(query, _of_strings(run)), {""}, False

    for op, arg in items:
        strings, inner = None, _ANY
        if op is K.LITERAL:
            strings = {chr(arg).lower()}
        elif op is K.IN:
            strings = _set_of(arg)
        elif op is K.SUBPATTERN:
            strings, inner = _walk(list(arg[3]))
        elif op is K.BRANCH:
            parts = [_walk(list(p)) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*[s for s, _ in parts])
            else:
                inner = _least(set().union(*[q if s is None else _of_strings(s) for s, q in parts]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, sub = arg
            strings, inner = _walk(list(sub))
            if low == 0:
                strings, inner = (strings | {""} if high == 1 and strings is not None else None), _ANY
            elif (low, high) != (1, 1):
                inner, strings = (_of_strings(strings) if strings is not None else inner), None
        if strings is None:
            end_run()
            query = _and(query, inner)
        else:
            joined = {a + b for a in run for b in strings}
            if len(joined) > _MOST_STRINGS:
                end_run()
                joined = strings if len(strings) <= _MOST_STRINGS else {""}
            run = joined
    if whole:
        return run, _ANY
    return None, _and(query, _of_strings(run))


def trigram_query(regex: str) -> Query:
    """Alternatives of lower-case trigrams, one of which any match holds whole; {empty set} if there is none."""
    strings, query = _walk(list(_parser.parse(regex)))
    query = query if strings is None else _of_strings(strings)
    return _ANY if frozenset() in query else query


def trigram_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name."""
    named = sorted({t for r in rules for a in trigram_query(r.regex) for t in a})
    if not named:
        return texts.select(F.lit("").alias("trigram"), "key").where(F.lit(False))
    held = F.filter(F.array(*[F.lit(t) for t in named]), lambda t: F.contains(F.col("low"), t))
    return texts.select("key", F.lower("text").alias("low")).select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the numbers of the rules whose query a text meets."""
    rows = [(t, r, k, len(a)) for r, rule in enumerate(rules) for k, a in enumerate(sorted(trigram_query(rule.regex), key=sorted)) for t in sorted(a)]
    # As many rows as the rules have trigrams: a fixed, small table.
    queries = index.sparkSession.createDataFrame(rows, "trigram string, rule int, alternative int, need long")
    hits = index.join(F.broadcast(queries), "trigram").groupBy("key", "rule", "alternative", "need").agg(F.count_distinct("trigram").alias("n"))
    return hits.where("n = need").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, order: int) -> Column:
    """The spans of a rule's matches in the column text, as array<struct<start, order, end, kind>>.

    split() leaves what stands between the matches, so the ends are running
    sums of lengths, taken in blocks: a text of many matches costs little more
    than their number.
    """
    regex = ("(?i)" if rule.any_case else "") + rule.regex
    matches = F.regexp_extract_all("text", F.lit(regex), F.lit(0))
    groups = F.regexp_extract_all("text", F.lit(regex), F.lit(rule.group)) if rule.group else matches

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocked(x: Column) -> Column:
        starts = F.sequence(F.lit(0), (F.size(x["l"]) / _BLOCK).cast("int"))
        return F.struct(x["m"].alias("m"), x["g"].alias("g"), x["l"].alias("l"), F.transform(starts, lambda c: total(F.slice(x["l"], c * _BLOCK + 1, _BLOCK))).alias("sums"))

    def based(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["g"].alias("g"), x["l"].alias("l"), F.transform(x["sums"], lambda _, c: total(F.slice(x["sums"], 1, c))).alias("before"))

    def placed(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = (i / _BLOCK).cast("int")
            to = F.get(x["before"], block) + total(F.slice(x["l"], block * _BLOCK + 1, i % _BLOCK + 1))
            return F.struct(to.alias("to"), F.length(m).alias("n"), F.length(F.get(x["g"], i)).alias("held"))

        return F.transform(x["m"], one)

    pieces = F.slice(F.split("text", regex, -1), F.lit(1), F.size(matches))
    value = F.array(F.struct(matches.alias("m"), groups.alias("g"), F.zip_with(pieces, matches, lambda p, m: F.length(p).cast("long") + F.length(m)).alias("l")))
    for step in (blocked, based, placed):
        value = F.transform(value, step)
    whole = F.element_at(value, 1)
    kept = F.filter(whole, lambda x: x["held"] >= rule.least) if rule.least else whole
    return F.transform(
        kept,
        lambda x: F.struct((x["to"] - x["n"]).alias("start"), F.lit(order).alias("order"), x["to"].alias("end"), F.lit(rule.kind).alias("kind")),
    )


_NONE = "cast(array() AS array<struct<start:bigint,order:int,end:bigint,kind:string>>)"


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows (text, key and any others) with the sorted spans of text."""
    found = candidates(trigram_index(rows, rules), rules)
    joined = rows.join(found, "key", "left")
    each = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.regex) == _ANY:
            wanted = F.col("text").rlike(("(?i)" if rule.any_case else "") + rule.regex)
        else:
            wanted = F.array_contains("rules", i)
        each.append(F.when(wanted, _spans(rule, i)).otherwise(sql(_NONE)))
    return joined.select(*rows.columns, F.array_sort(F.concat(*each)).alias("spans"))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and spans (start, order, end, kind; code points, end exclusive), sorted."""
    texts = doc_texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    return _with_spans(texts, rules).drop("key")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the spans of each document."""
    n_base = len(BASE_RULES)
    found = secret_scan(docs, rules)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["order"] < n_base)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


#: Code points of a block of text, from which redaction takes its parts.
_PIECE = 4096


def _redacted(text: str, spans: str) -> str:
    """SQL for a text with kinds in brackets for spans (sorted); overlapping spans become one, of the first one's kind.

    Parts are taken from blocks of the text and joined once, so that many spans cost little more than their number.
    """
    part = (
        f"substr(array_join(slice(tb, cast(pf div {_PIECE} + 1 AS int), cast((pt - 1) div {_PIECE} - pf div {_PIECE} + 1 AS int)), ''), "
        f"cast(pf % {_PIECE} + 1 AS int), cast(pt - pf AS int))"
    )

    def taken(frm: str, to: str) -> str:
        return let(f"cast({frm} AS bigint)", "pf", let(f"cast({to} AS bigint)", "pt", f"if(pt <= pf, '', {part})"))

    # reach: how far the spans up to each one go. A span that starts at or after the reach before it is written out.
    body = (
        "concat(array_join(transform(filter(transform(sp, (x, i) -> struct(x.start AS start, x.kind AS kind, if(i = 0, 0L, re[i - 1]) AS reach)), x -> x.start >= x.reach), "
        f"x -> concat({taken('x.reach', 'x.start')}, '[', upper(x.kind), ']')), ''), {taken('element_at(re, -1)', 'length(tx)')})"
    )
    blocks = f"transform(sequence(0, length(tx) div {_PIECE}), i -> substr(tx, cast(i * {_PIECE} + 1 AS int), {_PIECE}))"
    reach = running("transform(sp, x -> x.`end`)", "greatest(ra, ry)")
    return let(text, "tx", let(spans, "sp", let(blocks, "tb", let(reach, "re", body))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by its kind in brackets, and n_chars (if there) counted anew."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    flat = docs.toDF(*names).withColumn("text", F.coalesce(F.col(of["text"]), F.lit("")))
    scanned = _with_spans(flat.withColumn("key", F.xxhash64(F.col(of["doc_id"]).cast("long"), "text")), rules)
    cleaned = scanned.withColumn("clean", F.when(F.size("spans") > 0, sql(_redacted("text", "spans"))))
    new = {of["text"]: F.coalesce("clean", F.col(of["text"]))}
    if "n_chars" in of:
        kind = docs.schema[docs.columns.index("n_chars")].dataType
        new[of["n_chars"]] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(kind)).otherwise(F.col(of["n_chars"]))
    return cleaned.select(*[new.get(c, F.col(c)).alias(c) for c in names]).toDF(*docs.columns)
