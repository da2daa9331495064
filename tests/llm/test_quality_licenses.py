import re
import re._parser as sre
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm.licenses import BASE, _gate, doubled, license_scan, rules
from tessera.llm.quality import Rule, quality_rules


def measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality(docs, edge, empty):
    for df in (docs, edge):
        rows = quality_rules(df).collect()
        expected = [(i, *measures(t or "")) for i, t in df.select("doc_id", "text").collect()]
        assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:7]) for r in rows)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules(empty).count() == 0


def test_rules_of_quality(spark):
    good = "The cat sat on the mat and it was a fine day for all of us in the old house by the sea."
    rows = [(0, good), (1, good.replace(" ", " | ")), (2, " ".join(f"qwxz{i}" for i in range(60))), (3, "\n".join([good] + ["the same line"] * 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules(df).collect()} == {0: True, 1: False, 2: False, 3: False}
    assert quality_rules(df, ()).where("kept").count() == 3
    assert [r.n_stop for r in quality_rules(spark.createDataFrame([(0, "The THE the tHe und Und für FÜR")], "doc_id long, text string")).collect()] == [7]
    assert quality_rules(df, (Rule("symbol_ratio", 0.4),)).where("kept").select("doc_id").collect() == [(1,)]


@pytest.mark.parametrize("name", ["op1_document_fingerprints", "op2_secret_scan", "op3_quality_rules", "op4_license_scan", "op10_substring_dedup"])
def test_sql(spark, duck, name):
    from tessera.llm.oracles import ORACLE_SQL
    from tessera.llm.queries import QUERIES

    from .conftest import SF

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    found = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, rows))


def scan(text):
    """Base places and detections by brute force."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + "  ".join(words) + " " if words else ""
    every = []
    for phrase, label in BASE:
        parts = phrase.split()
        every += [(0, i, i + len(parts), label, 1.0) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    base = list(every)
    for r in rules():
        for m in re.finditer(f" {doubled(r.regex)} ", norm):
            s = norm[: m.start()].count(" ") // 2
            every.append((r.priority, s, s + m[0].count(" ") // 2, r.label, r.score))
    kept = [d for d in every if d[0] == 0 or not any(o[1] <= d[1] and o[2] >= d[2] and (o[0] < d[0] or (o[0] == d[0] and o[2] - o[1] > d[2] - d[1])) for o in every)]
    starts = [b[1] for b in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({b[3] for b in base})), ",".join(sorted({d[3] for d in kept})), max((d[4] for d in kept), default=0.0),
    )


def test_licenses(spark, docs, edge, empty):
    texts = [
        "Released under the terms of the GNU General Public License, version 3 or later. All rights reserved.", "SPDX-License-Identifier: Apache-2.0", "licensed under GPLv2",
        "cc by nc cc by nc nd 4.0 cc-by-nc-sa", "BSD 3-Clause License. New BSD license; the 2 clause BSD license", "mit gpl bsd cc apache general", "Under The MIT License " * 40, "K under the mit license",
        "dedicated to the public domain, Mozilla Public License v2.0, EPL", "under the mit license under the mit license",
    ]
    df = docs.select("doc_id", "text").union(edge.select("doc_id", "text")).union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = [tuple(r) for r in license_scan(df).drop("detections").collect()]
    expected = [(i, *scan(t or "")) for i, t in df.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert len(rules()) > 200 and license_scan(empty).count() == 0
    labels = {r.doc_id: r.labels for r in license_scan(df).where(F.col("doc_id") >= 1000).collect()}
    assert labels[1000] == "gpl-3,proprietary" and labels[1001] == "apache-2" and labels[1002] == "gpl-2"


def matches(regex):
    """All strings that a rule's regex matches; each is finite."""

    def of(parts):
        out = [""]
        for op, arg in parts:
            if op is sre.LITERAL:
                each = [chr(arg)]
            elif op is sre.IN:
                each = [chr(c) for kind, x in arg for c in ([x] if kind is sre.LITERAL else range(x[0], x[1] + 1))]
            elif op is sre.BRANCH:
                each = [s for p in arg[1] for s in of(p)]
            elif op is sre.SUBPATTERN:
                each = of(arg[3])
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                each = ["", *of(arg[2])]
            else:
                raise ValueError(op)
            out = [a + b for a in out for b in each]
        return out

    return sorted(set(of(sre.parse(regex))), key=lambda s: (len(s), s))


def test_gate_of_licenses(spark):
    """The first gate lets every match of every rule through, the license's word in it or not."""
    gate = re.compile(_gate().replace("\\\\", "\\"))
    assert [s for r in rules() for s in matches(r.regex) if not gate.search(s)] == []
    df = spark.createDataFrame([(1, "Released under BSD 3-Clause terms."), (2, "BSD Two-Clause"), (3, "freebsd")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan(df).collect()} == {1: "bsd-3-clause", 2: "bsd-2-clause", 3: ""}


def test_keywords_of_licenses(spark):
    """Every match of a rule holds the rule's keyword, and a text of each rule's shortest match gets what the rules without gates give."""
    assert [(r.keyword, s) for r in rules() for s in matches(r.regex) if r.keyword not in s] == []
    texts = [matches(r.regex)[0] for r in rules()] + ["SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: OFL-1.1"]
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: tuple(r)[1:-1] for r in rows}
    assert [t for i, t in enumerate(texts) if repr(found[i]) != repr(scan(t))] == []
    for i, r in enumerate(rules()):
        assert any(r.label == d[3] for d in next(x for x in rows if x.doc_id == i).detections), texts[i]
    assert [found[len(texts) - 3 + i][-2] for i in range(3)] == ["epl", "boost", "ofl-1.1"]


def test_many_phrases_in_one_text(spark):
    """A text of 20,000 words of license phrases costs little more than a short one."""
    text = "Released under the MIT License, apache license version 2. All rights reserved; CC BY-NC 4.0 or GPLv3! " * 1000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    license_scan(spark.createDataFrame([(1, text[:2000])], "doc_id long, text string")).collect()
    began = time.perf_counter()
    (row,) = license_scan(df).collect()
    took = time.perf_counter() - began
    assert repr(tuple(row)[1:-1]) == repr(scan_fast(text)) and took < 20, took


def scan_fast(text):
    """scan() of a text that is one sentence again and again: the labels of one or two, the places of all."""
    one = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) // 1000
    n, n_base, first, last, base, labels, score = scan(text[: 2 * len(text) // 1000])
    return 1000 * one, 500 * n_base, first, last + 998 * one, base, labels, score
