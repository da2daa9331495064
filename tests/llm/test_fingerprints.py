import hashlib

from pyspark.sql import functions as F

from tessera.llm.merkle import differences, document_fingerprints, edited_fingerprints, with_next


def pairs(rows):
    """Next texts by brute force: of the next smaller distinct doc_id the least text, nulls last."""
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    ids = sorted((i for i in by_id if i is not None), reverse=True) + ([None] if None in by_id else [])
    after = {i: min(by_id[ids[(n + 1) % len(ids)]], key=str.encode) for n, i in enumerate(ids)}
    return [(i, t or "", after[i]) for i, t in rows]


def check(df, got):
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    expected = []
    for i, t, after in pairs(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:3]) for r in got)


def test_edited_texts(spark, docs, edge):
    for df in (docs, edge, docs.limit(1)):
        check(df, edited_fingerprints(df).collect())


def test_many_ranges(spark, monkeypatch):
    import tessera.llm.merkle as m

    monkeypatch.setattr(m, "RANGE_ROWS", 3)
    df = spark.createDataFrame([(i * 37 % 101, f"t{i}") for i in range(101)] + [(5, "tie"), (5, "another tie"), (None, "none")], "doc_id long, text string")
    rows = [(r[0], r[1]) for r in df.collect()]
    found = sorted(map(repr, map(tuple, with_next(df).collect())))
    assert found == sorted(map(repr, pairs(rows)))


def test_empty_table(empty):
    assert edited_fingerprints(empty).count() == 0


def test_equal_roots_mean_equal_texts(spark, docs, edge):
    texts = [r[0] or "" for r in docs.select("text").union(edge.select("text")).collect()]
    texts += ["a. b", "a. \u0001b", "a.  b", "ab", "a\u0001b", "a\nb", "a\n\nb", "a b", "", "\n"]
    df = spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string")
    rows = document_fingerprints(df).withColumn("i", F.lit(0)).select("fingerprint").collect()
    assert len({r[0] for r in rows}) == len({r[0][:64] for r in rows}) == len(set(texts))


def test_likeness(spark):
    base = ". ".join(f"Sentence number {i} stands here" for i in range(40)) + "."
    rows = [(3, base), (2, base), (1, base.replace("number 7 ", "figure 7 ")), (0, "Nothing of the kind is said in this one")]
    near = {r.doc_id: r.near_next for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near[3] == 1.0 and 0.9 < near[2] < 1.0 and near[1] == 0.0 and near[0] == 0.0


def test_edit_is_located(spark):
    base = "\n".join(f"Paragraph number {i} stands here." for i in range(30))
    df = spark.createDataFrame([(0, base), (1, base.replace("number 17 ", "figure 17 "))], "doc_id long, text string")
    a, b = (r.fingerprint.split("|")[2].split(",") for r in document_fingerprints(df).orderBy("doc_id").collect())
    assert [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y] == [17]


def located(a, b):
    """differences() by brute force."""
    (ra, sa, pa), (rb, sb, pb) = ([x if k == 0 else x.split(",") for k, x in enumerate(f.split("|"))] for f in (a, b))
    if ra == rb:
        return [], []

    def inside(sections, paragraphs, picked):
        at, out = 0, []
        for i, x in enumerate(sections):
            n = int(x.split(":")[1])
            out += [(j, paragraphs[j]) for j in range(at, at + n)] if i in picked else []
            at += n
        assert at == len(paragraphs)
        return out

    da, db = [i for i, x in enumerate(sa) if x not in sb], [i for i, x in enumerate(sb) if x not in sa]
    other = {p for _, p in inside(sb, pb, db)}
    return da, [i for i, p in inside(sa, pa, da) if p not in other]


def test_descent(spark, docs):
    """Differing branches, against brute force, of edits anywhere and of texts that have nothing in common."""
    base = "\n".join(f"Paragraph number {i} stands here." if i % 5 else "" for i in range(200))
    texts = [base, base.replace("number 17 ", "figure 17 "), "Ahead\n" + base, base + "\nafter", "\n".join(base.split("\n")[:90]), base.replace("number", "figure"), "", "x", "a\n\na\n\na", "a\n\na"]
    texts += [r.text for r in docs.limit(12).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = document_fingerprints(df).select("doc_id", "fingerprint").cache()
    pairs = fps.toDF("i", "a").crossJoin(fps.toDF("j", "b")).select("i", "j", "a", "b", differences("a", "b").alias("d"))
    rows = pairs.collect()
    assert [(r.i, r.j) for r in rows if (list(r.d.sections), list(r.d.paragraphs)) != tuple(located(r.a, r.b))] == []
    one = next(r.d for r in rows if (r.i, r.j) == (0, 1))
    assert one.paragraphs == [17] and len(one.sections) == 1
    assert all(not r.d.sections for r in rows if r.i == r.j)
    fps.unpersist()
