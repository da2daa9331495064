import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substrings
from tessera.llm.components import components
from tessera.llm.simhash import _forest, fingerprint, keep_one, links, simhash_near_dedup
from tessera.llm.substrings import substring_dedup
from tessera.llm.wordhash import _BYTES, mix, roll, word_hashes


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check_simhash(df):
    rows = [(i, t or "") for i, t in df.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(fps)
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
        else:
            least.setdefault(g, None)
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        known = [x for x in (least.get(g), i) if x is not None]
        least[g] = min(known) if known else None
    expected = [(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group, strict=True)]
    found = [tuple(r) for r in simhash_near_dedup(df).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    return len(set(group))


def test_simhash(docs, edge, empty):
    check_simhash(docs)
    n = check_simhash(edge)
    kept = keep_one(edge)
    assert kept.count() == n and kept.columns == edge.columns
    assert keep_one(docs).count() == len({r.component_id for r in simhash_near_dedup(docs).collect()})
    assert simhash_near_dedup(empty).count() == 0 and keep_one(empty).count() == 0


def test_chains_and_crowds(spark, monkeypatch):
    """Chains of links, a crowd at one table entry dealt out again, and bits in either segment."""
    import tessera.llm.simhash as m

    monkeypatch.setattr(m, "CROWDED", 4)
    rng = random.Random(8)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4, 7))):
                x ^= 1 << b
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << b) for b in range(32)} | {center ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(a)}
    fps |= {0, (1 << 64) - 1, 1 << 63, 1 << 32, 1 << 31}
    fps = sorted(fps)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    stars = {r.node: r.component for r in components(links(df), "a", "b").collect()}
    group = brute_components(fps)
    found = {}
    for g, (f,) in zip(group, signed, strict=True):
        found.setdefault(g, set()).add(stars.get(f, f))
    assert all(len(v) == 1 for v in found.values()) and len({next(iter(v)) for v in found.values()}) == len(found)
    assert len(found) < len(fps) / 2


def test_one_huge_group(spark, monkeypatch):
    """A crowd at one entry of either segment is dealt out until each part is small, and no link is lost."""
    import tessera.llm.simhash as m

    monkeypatch.setattr(m, "CROWDED", 16)
    sizes = []
    rng = random.Random(3)
    low = {rng.getrandbits(32) for _ in range(1500)}
    near = {x ^ sum(1 << b for b in rng.sample(range(32), rng.choice((1, 2, 3)))) for x in rng.sample(sorted(low), 300)}
    fps = sorted({(77 << 32) + x for x in low | near} | {(x << 32) + 99 for x in low | near})
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    found = {frozenset(r) for r in links(spark.createDataFrame(signed, "fp long")).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in map(tuple, (x if len(x) == 2 else [*x, *x] for x in found)))
    stars = {r.node: r.component for r in components(links(spark.createDataFrame(signed, "fp long")), "a", "b").collect()}
    group = brute_components(fps)
    seen = {}
    for g, (f,) in zip(group, signed, strict=True):
        seen.setdefault(g, set()).add(stars.get(f, f))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    rows = spark.createDataFrame([(f, 77, 0) for (f,) in signed[:1500]], "fp long, key long, mask long")
    for _ in range(3):
        rows = m._dealt(rows)
        sizes.append(rows.groupBy("key").count().agg({"count": "max"}).first()[0])
    assert sizes[-1] < sizes[0] < 200


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(1000, rng.randint(1001, 1100)) for _ in range(150)] + [(7, 7), (2000, 1999)]
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()}
    assert found == {i: find(i) for i in label if find(i) != i}
    assert components(spark.createDataFrame([], "p long, q long"), "p", "q").count() == 0


def test_forest():
    fps = np.array([0, 1, 3, 7, 31 << 40, (31 << 40) + 15], np.uint64)
    assert len(_forest(fps, 3)) == 3


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab C\t\n\x0bé😀", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def brute_substrings(rows, window=20):
    """Rows in order of doc_id (nulls last), and of the text's hash where equal; equal rows once."""
    docs = {}
    for i, t, h in rows:
        docs[(2**63 - 1 if i is None else i, h)] = (t or "").encode().split()
    seen, out = set(), {}
    for key in sorted(docs):
        words = docs[key]
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            w = tuple(words[j : j + window])
            if w in seen:
                gone[j : j + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[key] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return [(i, *out[(2**63 - 1 if i is None else i, h)]) for i, _, h in rows]


def check_substrings(df):
    rows = [tuple(r) for r in df.selectExpr("doc_id", "text", "cast(shiftright(xxhash64(coalesce(text, '')), 32) as int)").collect()]
    found = [tuple(r) for r in substring_dedup(df, digest=True).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_substrings(rows)))
    return sum(r[2] for r in found)


def test_substrings(docs, edge, empty):
    assert check_substrings(docs) > 100
    assert check_substrings(docs.repartition(9)) > 100
    assert check_substrings(edge) > 100
    assert substring_dedup(empty).count() == 0


def test_substrings_of_few_words(spark):
    """Few distinct words make many repeats, overlapping ones and ones inside a text."""
    rng = random.Random(2)
    rows = [(i // 2, " ".join(rng.choices("ab", [9, 1], k=rng.randint(0, 120)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check_substrings(df) > 1000


def test_kept_text(spark):
    p = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, p), (2, f"a {p}  b\n{p} c")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring_dedup(df).collect()} == {1: p, 2: "a b c"}


def repeated(texts, n_groups=8, heavy=()):
    """The groups that texts, each read by a task of its own, are dealt to, and the repeats found in them."""
    dealt = []
    for i, t in enumerate(texts):
        batch = pa.record_batch([pa.array([i], pa.int64()), pa.array([0], pa.int32()), pa.array([t])], names=["k", "th", "text"])
        dealt += substrings._suffixes(iter([batch]), n_groups, 20, 8, np.array(heavy, np.int64))
    return dealt, sorted(tuple(r.values())[:4] for b in substrings._repeats(iter(dealt)) for r in b.to_pylist())


def hot_texts(n):
    """Texts that share 18 words and differ around them; the last repeats the first."""
    hot = " ".join(f"hot{i}" for i in range(18))
    texts = [" ".join(f"a{j}x{i}" for i in range(12)) + f" {hot} " + " ".join(f"b{j}x{i}" for i in range(12)) for j in range(n)]
    return [*texts, texts[0]]


def test_windows_that_differ_in_high_bits(monkeypatch):
    """Windows below one anchor at one place are told apart by all bits of their hash."""
    monkeypatch.setattr(substrings, "roll", lambda h, n: roll(h, n) & np.uint64(2**64 - 2**40) if n == 20 else roll(h, n))
    found = repeated(hot_texts(40))[1]
    assert {r[0] for r in found} == {40} and sum(r[3] for r in found) == 23


def held(batches, n_groups):
    """The windows that each group holds."""
    n = [0] * n_groups
    for b in batches:
        for g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if g >= 0:
                n[g] += int(np.frombuffer(raw, substrings._SUFFIX, int(np.frombuffer(raw, np.int32, 1)[0]), 4)["n"].sum())
    return n


def test_hot_anchors_are_split(spark, monkeypatch):
    """A prefix that holds too many windows is dealt to all groups, and the repeats stay the same."""
    texts = hot_texts(400)
    whole, found = repeated(texts)
    batches = [pa.record_batch([pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([t])], names=["k", "th", "text"]) for t in texts]
    counts = [c for b in batches for c in substrings._counts(iter([b]), 8 * substrings.FINER, 20, 8)]
    assert sum(held(whole, 8)) == 401 * 23
    heavy = [r["prefix"] for b in substrings._heavy(iter(counts), 500) for r in b.to_pylist()]
    split, again = repeated(texts, heavy=heavy)
    windows = lambda spans: sorted((k, start + i) for k, _, start, n in spans for i in range(n))
    assert windows(again) == windows(found) and sum(held(split, 8)) == sum(held(whole, 8))
    assert max(held(whole, 8)) > 1.5 * sum(held(whole, 8)) / 8 and max(held(split, 8)) < 1.5 * sum(held(whole, 8)) / 8
    monkeypatch.setattr(substrings, "MOST_WINDOWS", 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert check_substrings(df) == 42
    rows = [(i // 2, t) for i, t in enumerate([*texts, *(" ".join("ab"[i * j % 7 == 0] for i in range(90)) for j in range(60))])]
    assert check_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) > 1000


def test_windows_whose_hashes_collide(spark, monkeypatch):
    """Words decide: where different windows have equal hashes, all is done again with other values."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    texts += [texts[0], "x " + texts[1] + " y", " ".join(texts[2].split()[10:45])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    tried, real, once = [], substrings._values, substrings._once
    # Equal values: words of one length have one hash, so all windows of these texts seem equal.
    monkeypatch.setattr(substrings, "_values", lambda salt: np.full(256, 3, np.uint64) if salt < 2 else real(salt))
    monkeypatch.setattr(substrings, "_once", lambda *a: tried.append(a[-1]) or once(*a))
    assert check_substrings(df) == 60 + 60 + 35 and tried == [0, 1, 2]


def test_word_hashes():
    texts = [b"one two", b"", b" two\tthree ", b"x" * 3000 + b" one"]
    off = np.cumsum([0, *map(len, texts)])
    h, n = word_hashes(np.frombuffer(b"".join(texts), np.uint8), off)
    assert n.tolist() == [2, 0, 2, 2]
    assert h[1] == h[2] and h[0] == h[5] and len(set(h.tolist())) == 4
    many = [f"w{i}".encode() for i in range(50_000)]
    data = np.frombuffer(b" ".join(many), np.uint8)
    assert len(set(word_hashes(data, np.array([0, len(data)]))[0].tolist())) == 50_000
    assert len(set(_BYTES.tolist())) == 256


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 25))
def test_roll(words, n):
    h = mix(np.array(words, np.uint64) + np.uint64(1))
    runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    found = roll(h, n).tolist()
    assert len(found) == len(runs)
    assert all((a == b) == (x == y) for a, x in zip(runs, found, strict=True) for b, y in zip(runs, found, strict=True))
