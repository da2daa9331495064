"""Mixing sources to target weights by soft membership.

A classifier trained on the labelled ones of the given documents predicts for
each document the posterior of its domains: clean, poor (labels.quality 0) and
toxic. Labels of other documents count neither for the domains' shares nor for
the sample. A document
of n words then has n times its posteriors as expected tokens of the domains.
Rates are fitted so that the expected tokens, times the rates, meet the target
totals: least squares under bounds, by projected gradient steps. A document's
step is a product of its few posteriors with one small vector, so the rates need
not be stored between steps. A step is one pass over
narrow rows that returns a few sums, and a rate is a function of its own row:
there is no shuffle and no join, and a hot source or domain is just many rows.

Targets are weights; the first domain's total stays what it is, the others
follow. Rates stay at or above 0; further bounds are parameters and off unless
given: a most for each domain, and a least rate for documents whose first domain
is the likeliest (the corpus pipeline gives 1 there, so that none of them is
dropped). How far the fit stays from the targets is returned with it. A rate
becomes a number of copies by a hash of doc_id and length, with the rate as its
expectation.

Defined cases: null and empty texts have no tokens and keep rate 1. Texts are
read whole, whatever their length. Without labels all posteriors are equal.
Labels that are null do not count; of several for a doc_id the worst does. Of
domains that are equally likely the first named counts as the likeliest. Empty
tables give no rows. Repeated rows each get a row; other columns are ignored by
the fit, whatever their names, and kept by ``mixed``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, frugal, pick, written
from .toxicity import CHUNK_BYTES, Model, trained
from .wordhash import chunks

DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.95, "poor": 0.04, "toxic": 0.01}
#: Labelled texts of each domain that the classifier learns from, at most.
PER_DOMAIN = {0: 1800, 1: 900, 2: 700}
STEPS = 20
CLOSE = 1e-4
#: The share of a step from which on it is made smaller no more.
SMALLEST = 1e-3
#: From this residual on a fit says so in the log.
OUT_OF_REACH = 1e-2
_LOG = logging.getLogger(__name__)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the number of each labelled document's domain."""
    rows = pick(labels, "doc_id", "quality", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    return rows.withColumn("label", domain).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))


def _posteriors(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch, "mix_text", CHUNK_BYTES):
            p, n = model.posteriors(chunk.column("mix_text"))
            own = [chunk.column(c) for c in range(chunk.num_columns - 1)]
            cols = [*own, pa.array(n), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])]]
            yield pa.record_batch(cols, names=[*chunk.schema.names[:-1], "n_tokens", *[f"p_{d}" for d in DOMAINS]])


def with_posteriors(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep (as _c0, _c1, ...), n_tokens and a posterior p_<domain> for each domain."""
    here = pick(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"))
    known = written(domains_of(labels).join(here, "doc_id", "left_semi"))
    model = trained(docs, known, PER_DOMAIN)
    forget(known)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    every = docs.toDF(*names)
    text = F.coalesce(F.col(names[docs.columns.index("text")]), F.lit(""))
    kept = [F.col(names[docs.columns.index(c)]).alias(f"_c{i}") for i, c in enumerate(keep)]
    flat = every.select(*kept, text.alias("mix_text"))
    rows = flat.drop("mix_text")
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields], "n_tokens long", *[f"p_{d} double" for d in DOMAINS]])
    return flat.mapInArrow(lambda it: frugal(_posteriors(it, model)), schema)


def _bounds(names: list[str], most: dict[str, float] | None, floor: float) -> tuple[Column, Column]:
    """The least and greatest rate of a document, by its likeliest domain."""
    ps = [F.col(f"p_{d}") for d in names]
    likeliest = F.greatest(*ps)
    low = F.when(ps[0] == likeliest, float(floor)).otherwise(0.0)
    high = F.lit(float("inf"))
    for d, p in reversed(list(zip(names, ps, strict=True))):
        high = F.when(p == likeliest, F.lit(float((most or {}).get(d, "inf")))).otherwise(high)
    return low, F.greatest(high, low)


def _rate(moved: np.ndarray, names: list[str], low: Column, high: Column) -> tuple[Column, Column]:
    """The rate after all steps so far, whose sum is moved: before its projection between the bounds, and after."""
    bare = sum((F.col(f"p_{d}") * float(x) for d, x in zip(names, moved, strict=True)), F.lit(0.0)) * F.col("n_tokens") + 1.0
    return bare, F.least(high, F.greatest(low, bare))


@dataclass
class Fit:
    """rate: a function of the columns of with_posteriors(). expected and wanted: each domain's tokens. residual: the greatest gap, as a share of all wanted tokens."""

    rate: Column
    expected: dict[str, float]
    wanted: dict[str, float]
    residual: float


def fit_rates(scored: DataFrame, targets: dict[str, float] = TARGETS, most: dict[str, float] | None = None, floor: float = 0.0, steps: int = STEPS) -> Fit:
    """Rates that bring the expected tokens as near to the targets as the bounds let them; scored is read once a step.

    A gradient of the least squares is, for each document, a product of its
    tokens by domain with the gap between targets and expected totals, so the
    sum of all steps is one small vector, and a rate is the projection of what
    that vector makes of it. The metric of a step is that of the documents
    between their bounds, as those at a bound do not move, with a little of all
    documents'. A step that widens the gap is made smaller.
    """
    names = list(targets)
    k = len(names)
    ps = [F.col(f"p_{d}") for d in names]
    n = F.col("n_tokens").cast("double")
    weights = np.array([targets[d] for d in names], float)
    if not (weights >= 0).all() or weights[0] <= 0:
        raise ValueError("weights must not be negative, and the first must be positive")

    low, high = _bounds(names, most, floor)

    def totals(moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass: the expected tokens, and the second moments of all documents and of those between their bounds."""
        bare, rate = _rate(moved, names, F.col("low"), F.col("high"))
        rows = scored.select("n_tokens", *ps, low.alias("low"), high.alias("high")).withColumns({"bare": bare, "rate": rate})
        inside = F.when((F.col("bare") > F.col("low")) & (F.col("bare") < F.col("high")), 1.0).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.sum(n * p * F.col("rate")) for p in ps] + [F.sum(of * n * n * ps[i] * ps[j]) for of in (F.lit(1.0), inside) for i, j in pairs]
        row = np.array([x or 0.0 for x in rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()])
        moments = np.zeros((2, k, k))
        for m, values in zip(moments, row[k:].reshape(2, -1), strict=True):
            for (i, j), x in zip(pairs, values, strict=True):
                m[i, j] = m[j, i] = x
        return row[:k], *moments

    at = np.zeros(k)
    have, whole, free = totals(at)
    first = have[0] if floor <= 1.0 <= float((most or {}).get(names[0], "inf")) else float(scored.agg(F.sum(n * ps[0])).first()[0] or 0.0)
    want = first * weights / weights[0]
    scale = float(want.sum())
    if scale <= 0:
        return Fit(F.lit(1.0), dict(zip(names, have.tolist(), strict=True)), dict(zip(names, want.tolist(), strict=True)), 0.0)
    size = np.linalg.norm(want - have)
    for _ in range(steps):
        gap = want - have
        if np.abs(gap).max() < CLOSE * scale:
            break
        step, share = np.linalg.pinv(free + 1e-3 * whole, rcond=1e-12, hermitian=True) @ gap, 1.0
        while share > SMALLEST:
            then, _, then_free = totals(at + share * step)
            if (then_size := np.linalg.norm(want - then)) < size:
                break
            share /= 4
        else:
            break
        at, have, free, size = at + share * step, then, then_free, then_size
    residual = float(np.abs(want - have).max() / scale)
    if residual > OUT_OF_REACH:
        _LOG.warning("the expected tokens stay %.2g of all wanted tokens from their targets", residual)
    return Fit(_rate(at, names, low, high)[1], dict(zip(names, have.tolist(), strict=True)), dict(zip(names, want.tolist(), strict=True)), residual)


def _copies(rate: Column, *key: Column) -> Column:
    share = F.shiftrightunsigned(F.xxhash64(*key, F.lit("mix")), 11) / float(2**53)
    return F.floor(rate + share).cast("int")


def mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: dict[str, float] | None = None, floor: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, the posteriors, rate and copies of every document, and the residual of the whole fit."""
    ids = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = written(with_posteriors(ids, labels, ["doc_id"]))
    fit = fit_rates(scored, targets, most, floor)
    return scored.select(F.col("_c0").alias("doc_id"), "n_tokens", *[f"p_{d}" for d in targets], fit.rate.alias("rate")).withColumns(
        {"copies": _copies(F.col("rate"), F.col("doc_id"), F.col("n_tokens")), "residual": F.lit(fit.residual)}
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: dict[str, float] | None = None, floor: float = 0.0) -> DataFrame:
    """The documents, each row as often as its copies say, all columns."""
    scored = written(with_posteriors(docs, labels, docs.columns))
    rate = fit_rates(scored, targets, most, floor).rate
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key = F.col(names[docs.columns.index("doc_id")]).cast("long")
    repeated = scored.withColumn("rate", rate).withColumn("again", F.explode(F.sequence(F.lit(0), _copies(F.col("rate"), key, F.col("n_tokens"))))).where("again > 0")
    return repeated.select(*names).toDF(*docs.columns)
