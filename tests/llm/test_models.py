import html
import pickle
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import lattice, mixing, pieces, toxicity, webtext
from tessera.llm.common import load

from .conftest import SF

MEDIUM = SF.replace("sf0.001", "sf0.1")


def test_toxicity_held_out(spark):
    docs, labels = load(spark, MEDIUM, "documents"), load(spark, MEDIUM, "labels")
    scored = toxicity.toxicity(docs, labels).cache()
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    known = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    score, said, truth = (np.array([r[i] for r in known]) for i in range(3))
    order = np.argsort(np.argsort(score))
    auc = (order[truth == 1].mean() - (truth.sum() - 1) / 2) / (truth == 0).sum()
    assert auc > 0.93 and said[truth == 1].mean() > 0.7 and said[truth == 0].mean() < 0.04
    scored.unpersist()


def test_toxicity_learns_from_its_rows_only(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (dict(toxicity.toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_misspellings():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioustrn"), 5)) for _ in range(300)]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    bad = [" ".join([*rng.choice(words, 57), "blorgwump", "zzskank", "blorgwump"]) for _ in range(150)]
    model = toxicity.train(clean + bad, np.array([0] * 300 + [1] * 150))
    text = " ".join(rng.choice(words, 57))
    low, high = model.scores(pa.array([text, text + " blorgwumpy zzskanks blorgwumps"]))
    assert low < 0.3 < high
    assert model.scores(pa.array([""]))[0] == pytest.approx(1 / 3, abs=1e-6)


def test_toxicity_cases(spark, edge, empty, labels):
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == edge.count() and not any(r.held_out for r in rows if r.doc_id is None)
    kept = toxicity.without_toxic(edge, labels)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)
    none = labels.where("false")
    assert {r.score for r in toxicity.toxicity(edge, none).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.without_toxic(empty, labels).count() == 0


def test_mixing_meets_targets(spark):
    docs, labels = load(spark, MEDIUM, "documents"), load(spark, MEDIUM, "labels")
    rows = mixing.mixing(docs, labels, most={"clean": 4.0, "poor": 1.0, "toxic": 1.0}, floor=1.0).cache()
    sums = rows.agg(*[F.sum(F.expr(f"rate * n_tokens * p_{d}")).alias(d) for d in mixing.DOMAINS], F.sum(F.expr("n_tokens * p_clean")).alias("now")).first()
    for d in mixing.DOMAINS:
        assert sums[d] == pytest.approx(sums["now"] * mixing.TARGETS[d] / mixing.TARGETS["clean"], rel=0.01)
    assert rows.where("rate < 0 OR copies < 0 OR (p_clean >= greatest(p_poor, p_toxic) AND copies < 1)").count() == 0
    assert rows.agg(F.sum("copies")).first()[0] == pytest.approx(rows.agg(F.sum("rate")).first()[0], rel=0.02)
    rows.unpersist()


def test_mixing_counts_its_own_documents(spark, monkeypatch):
    """Shares and sample are of the labelled documents that the stage is given, not of all labels."""
    labels = load(spark, SF, "labels")
    domain = {r.doc_id: r.label for r in mixing.domains_of(labels).collect()}
    docs = load(spark, SF, "documents")
    docs = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").where("doc_id % 3 > 0").select(docs.columns)
    given = []
    of = toxicity.training_sample

    def noted(*a):
        sample, shares = of(*a)
        given.append(({r.doc_id for r in sample.collect()}, shares))
        return sample, shares

    monkeypatch.setattr(toxicity, "training_sample", noted)
    rows = mixing.mixing(docs, labels).collect()
    at = [domain[r.doc_id] for r in rows if r.doc_id in domain]
    assert at and given[0][1] == pytest.approx([at.count(c) / len(at) for c in range(3)])
    assert given[0][0] <= {r.doc_id for r in rows}
    assert sum(r.n_tokens * r.p_toxic for r in rows) < 1e-3 * sum(r.n_tokens for r in rows)


def test_mixing_out_of_reach(spark):
    """Targets that bounds keep from being met: the rates go to their bounds, and the residual tells."""
    df = spark.createDataFrame([(100, 1.0, 0.0, 0.0), (10, 0.0, 1.0, 0.0), (10, 0.0, 0.0, 1.0)], "n_tokens long, p_clean double, p_poor double, p_toxic double")
    fit = mixing.fit_rates(df, {"clean": 0.5, "poor": 0.5, "toxic": 0.0}, {"poor": 1.0, "toxic": 1.0}, 1.0)
    assert [round(r[0], 3) for r in df.select(fit.rate).collect()] == [1.0, 1.0, 0.0]
    assert fit.residual == pytest.approx(0.45) and fit.expected["poor"] == pytest.approx(10) and fit.wanted["poor"] == pytest.approx(100)
    free = mixing.fit_rates(df, {"clean": 0.5, "poor": 0.5, "toxic": 0.0})
    assert [round(r[0], 2) for r in df.select(free.rate).collect()] == [1.0, 10.0, 0.0] and free.residual < 1e-3
    with pytest.raises(ValueError):
        mixing.fit_rates(df, {"clean": 0.0, "poor": 1.0, "toxic": 0.0})


@pytest.mark.parametrize("targets", [(0.95, 0.04, 0.01), (0.5, 0.3, 0.2), (0.05, 0.0, 0.95)])
def test_rates_against_least_squares(spark, targets):
    """The residual is that of nonnegative least squares over all rates, by plain numpy steps of each rate alone."""
    rng = np.random.default_rng(int(targets[0] * 100))
    n = rng.integers(1, 400, 60)
    p = rng.dirichlet([0.4, 0.2, 0.2], 60)
    rows = [(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)]
    df = spark.createDataFrame(rows, "n_tokens long, p_clean double, p_poor double, p_toxic double").coalesce(1).cache()
    fit = mixing.fit_rates(df, dict(zip(mixing.DOMAINS, targets, strict=True)), steps=60)
    part = n[:, None] * p
    want = part[:, 0].sum() * np.array(targets) / targets[0]
    rate = np.ones(60)
    for _ in range(4000):
        for i in range(60):
            rate[i] = max(0.0, rate[i] + part[i] @ (want - rate @ part) / (part[i] @ part[i]))
    found = np.array([r[0] for r in df.select(fit.rate).collect()])
    assert (found >= 0).all()
    assert np.allclose(found @ part, [fit.expected[d] for d in mixing.DOMAINS], rtol=1e-6, atol=1e-6 * want.sum())
    gap, best = (np.abs(want - x @ part).max() / want.sum() for x in (found, rate))
    assert fit.residual == pytest.approx(gap, abs=1e-6) and gap <= best + 1e-3
    df.unpersist()


def test_scores_against_plain_embeddings():
    """The folded weights, hashed words and sums in arrays give the averaged embeddings' softmax, n-gram by n-gram."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=(1 << toxicity.BUCKET_BITS, 2)).astype(np.float32), np.array([0.3, -0.2]))
    texts = ["", " ", "Some words, some WORDS é 日本", "a", "x " * 50 + "yy"]
    found, n_words = model.posteriors(pa.array(texts))
    for text, p, n in zip(texts, found, n_words, strict=True):
        counts = {}
        for w in text.encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
        total, size = np.zeros(2), toxicity.NEUTRAL
        for w, c in counts.items():
            for g in toxicity.NGRAMS:
                marked = b" " + w + b" "
                for i in range(len(marked) - g + 1):
                    value = 0
                    for x in marked[i : i + g]:
                        value = (value * 0x9E3779B97F4A7C15 + int(toxicity._VALUES[x])) % 2**64
                    bucket = int(toxicity.mix(np.array([(value + g) % 2**64], np.uint64))[0]) >> (64 - toxicity.BUCKET_BITS)
                    total += c**0.5 * model.weight[bucket]
                    size += c**0.5
        odds = np.concatenate([[0.0], model.bias + toxicity.GAIN * total / size])
        e = np.exp(odds - odds.max())
        assert n == sum(counts.values()) and np.allclose(p, e / e.sum(), atol=1e-9)


def test_mixing_cases(edge, empty, labels):
    rows = mixing.mixing(edge, labels).collect()
    assert len(rows) == edge.count() and all(r.rate == 1 for r in rows if r.n_tokens == 0 and r.p_clean >= max(r.p_poor, r.p_toxic))
    mixed = mixing.mixed(edge, labels)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixing(empty, labels).count() == 0 and mixing.mixed(empty, labels).count() == 0
    assert mixing.mixing(edge, labels.where("false")).count() == edge.count()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_the_library(spark, library, docs, edge, empty):
    for df in (docs, edge):
        for most in (50, 100_000):
            rows = pieces.encode(df, most=most).join(df.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t")), F.col("doc_id").eqNullSafe(F.col("i")))
            found = [(r.ids, library.encode(r.t), r.round_trip, r.t) for r in rows.collect()]
            by_text = {t: (e, ok) for ids, e, ok, t in found if list(ids) == e}
            assert {t for *_, t in found} == set(by_text)
            assert all(ok == ("▁" not in t) for t, (_, ok) in by_text.items())
    assert pieces.encode(edge).count() == edge.count() and pieces.encode(empty).count() == 0


def test_all_words_through_the_lattice(docs, edge, empty):
    """Joined back by document and word, the lattice in Spark gives what the words in place give."""
    some = docs.where("n_chars < 1500")
    for df in (some.limit(40), edge.where("doc_id NOT IN (6, 7) OR doc_id IS NULL")):
        found = pieces.encode(df, most=30, joined=True).collect()
        assert sorted(map(repr, found)) == sorted(map(repr, pieces.encode(df, most=30).collect()))
    assert pieces.encode(empty, joined=True).count() == 0


def test_lattice_in_spark(spark, library):
    words = ["Hello", "world", "", " ", "   x", "unbelievable", "日本語", "😀é", "ﬁ", "<0x0A>", "\n", "\nThe", "  \nThe", "a\tb", "aaaaaaaaaaaaaaaaaaaa", "----------", "'s.", "Äußerst,"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table = pieces.load_pieces()
    found = {r.word: r.ids for r in pieces.encode_words(df, table).collect()}
    for w in words:
        expected = np.frombuffer(table.encode_word(pieces.spaced(w, True)), np.int32).tolist()
        assert found[w] == expected
        if w and w.lstrip(" ")[:1] != "\n":
            assert expected == library.encode(w)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab the.,ing éè日😀\n\t<>|0▁", max_size=40))
def test_encoding_equals_the_library(text):
    import sentencepiece

    table = pieces.load_pieces()
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known, met = {}, bytearray(pieces._MET >> 3)
    for _ in range(3):  # the third time from what was remembered
        ids = table.encode(text, known, met)
        assert ids.tolist() == lib.encode(text)
    assert table.decode(ids) == text.replace("▁", " ")


def test_lattices_side_by_side(library, monkeypatch):
    """New words go through the lattice together, in a worker's second task with the pairs of the first; those of over 64 characters walk alone."""
    table = pieces.load_pieces()
    rng = np.random.default_rng(5)
    parts = ["tion", "ing", "ß", "ä", "###", ",", "日", "😀", "é", "\t", "\x01", "0", "7", "Wh", "a", "\u0378"]
    words = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3000)] + ["\nThe", "x" * 64, "x" * 65, "ab" * 500, "\n", " ", "  \n😀"]
    texts = [" ".join(words[:2000]), "", " ".join(words[1000:]), *words[-7:]]
    walked = []
    walk = pieces.Pieces.encode_word
    monkeypatch.setattr(pieces.Pieces, "encode_word", lambda self, w: walked.append(w) or walk(self, w))
    found = table.encode_texts(texts, {})
    assert [i.tolist() for i in found] == [library.encode(t) for t in texts]
    assert walked and all(len(w) > lattice.LONGEST for w in walked)
    again = pickle.loads(pickle.dumps(table))
    n = pieces._lattice(table).pairs.n
    assert [i.tolist() for i in again.encode_texts(texts, {})] == [i.tolist() for i in found]
    assert pieces._lattice(again).pairs.n == n > 0


def test_pairs_are_bounded(library, monkeypatch):
    """Pairs that were forgotten are tried again, and no number is lost but by the bound."""
    table = pieces.load_pieces()
    numbers, expected = lattice.Numbers(), {}
    rng = np.random.default_rng(6)
    for _ in range(40):
        keys = np.array([k for k in np.unique(rng.integers(0, 1 << 45, 997)).tolist() if k not in expected], np.int64)
        numbers.put(keys, np.arange(len(keys), dtype=np.int32))
        expected |= dict(zip(keys.tolist(), range(len(keys)), strict=True))
    assert numbers.get(np.array([*expected, *range(50)], np.int64)).tolist() == [*expected.values(), *[-1] * 50]
    monkeypatch.setattr(pieces, "_LATTICES", {})
    pieces._lattice(table).pairs.most = 1 << 12
    words = ["".join(rng.choice(list("etaoinshrdlu,."), 9)) for _ in range(6000)]
    assert table.encode_texts([" ".join(words)], {})[0].tolist() == library.encode(" ".join(words))
    assert len(pieces._lattice(table).pairs.keys) <= 1 << 15


def test_decoding(spark, edge):
    encoded = pieces.encode(edge)
    texts = sorted(map(repr, pieces.decode(encoded).collect()))
    rows = [(i, (t or "").replace("▁", " ")) for i, t in edge.select("doc_id", "text").collect()]
    assert len(texts) == len(rows) and texts == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xFF])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode(odd).orderBy("doc_id").collect()] == ["", "", "�"]


def test_pages_of_the_table(spark):
    """In the given pages the article is what <article> holds; tags and entities are undone here by rules."""
    pages = load(spark, MEDIUM, "pages")
    found = {r.page_id: r.text for r in webtext.extract(pages).collect()}
    wrong = 0
    for i, h in pages.select("page_id", "html").collect():
        inner = h[h.find("<article>") : h.find("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        wrong += found[i] != "\n\n".join(b for b in blocks if b)
    assert wrong <= 0.01 * len(found)


def test_held_out_pages():
    chain = webtext.default_chain()
    hits = misses = false = 0
    for seen, labels in webtext.labelled_pages(300, seed=77):
        for said, truth in zip(chain.decode(chain.odds(seen, {})), labels, strict=True):
            hits, misses, false = hits + (said and truth), misses + (truth and not said), false + (said and not truth)
    assert 2 * hits / (2 * hits + misses + false) > 0.97


def test_viterbi_and_marginals():
    """Against all labellings of a short chain."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        odds, pair, ends = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
        ways = [[w >> i & 1 for i in range(n)] for w in range(2**n)]
        score = np.array([sum(o for o, y in zip(odds, ys, strict=True) if y) + ends[0, ys[0]] + ends[1, ys[-1]] + sum(pair[a, b] for a, b in zip(ys, ys[1:], strict=False)) for ys in ways])
        assert webtext.Chain({}, pair, ends).decode(odds.tolist()) == ways[int(score.argmax())]
        p = np.exp(score - score.max())
        p /= p.sum()
        one, both = webtext._marginals(odds, pair, ends)
        assert np.allclose(one, p @ np.array(ways))
        for a in (0, 1):
            for b in (0, 1):
                assert np.isclose(both[a, b], sum(q * sum(x == (a, b) for x in zip(ys, ys[1:], strict=False)) for q, ys in zip(p, ways, strict=True)))


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=x><!-- <p>no</p> --><p>One &amp; <b>two<br>three</p><p>four<p>five"
        "<script>if (a < b) '</p>'</script><ul><li>six<li>seven</ul><div>eight <a href='a>b'>nine</a></div>10 < 11 &lt; 12 &#65;&unknown;<textarea>no</textarea></body>"
    )
    assert [b.text for b in webtext.blocks(page)] == ["One & two three", "four", "five", "six", "seven", "eight nine", "10 < 11 < 12 A&unknown;"]
    assert [b.text for b in webtext.blocks("a<!-- never ends")] == ["a"]
    assert [b.text for b in webtext.blocks("a<script>x")] == ["a"] and webtext.blocks("") == []
    # U+00A0 is white space as well: "turn white space inside a block into one space".
    assert [b.text for b in webtext.blocks("<p>a\u00a0b \t\n c&nbsp; d</p><p class='")] == ["a b c d"]


def test_blocks_of_odd_pages():
    """Optional tags of the head, unclosed elements without text, and elements whose words are text."""
    of = lambda page: [b.text for b in webtext.blocks(page)]
    assert of("<html><head><title>T</title><style>p{}</style><article><p>one<p>two</article>") == ["one", "two"]
    for tag in ("object", "select", "svg", "video", "audio", "template", "math", "canvas", "noscript", "map"):
        assert of(f"<body><div><{tag} class=x></div><p>one</p><div>two</div>")[-2:] == ["one", "two"], tag
        assert of(f"<body><p><span><{tag}></span> one</p><p>two</p>")[-2:] == ["one", "two"], tag
    assert of("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p><noscript><p>no script</p></noscript><object>an object</object><canvas>a chart</canvas>") == [
        "if x=1 then", "no script", "an object", "a chart",
    ]
    assert of("<div>a<svg><g><text>no</text></g><path/></svg>b<select><option>no<option>no</select>c<video><p>no</p></video>d<template><p>no</template>e") == ["abcde"]


def test_page_parts_are_left_out():
    page = (
        "<body><header>Site name</header><div class='cookie-notice'>We use cookies on this site. Please agree.</div><nav><a href=/>Home</a></nav>"
        "<div class='sidebar'><h3>Related</h3><p>Read this other story which is long enough.</p></div><article><h1>The title</h1><p>First part here &amp; there.</p>"
        "<div class='advert'><p>Buy now this thing.</p></div><p>Second part.</p><form><label>Email</label><p>Sign up for news.</p></form></article>"
        "<section class='comments'><p>I liked this article a lot, thank you.</p><p>Me too.</p></section><footer>(c) x</footer>"
    )
    assert webtext.main_text(page, webtext.default_chain()) == "The title\n\nFirst part here & there.\n\nSecond part."


#: Layouts written by hand: (page, blocks of the article).
LAYOUTS = [
    ("<html><body><p>One plain paragraph that says a little about something.</p><p>Second one, which goes on with it for a while.</p></body></html>",
     ["One plain paragraph that says a little about something.", "Second one, which goes on with it for a while."]),
    ("<p>Only one paragraph stands here, with no other tag around it at all.", ["Only one paragraph stands here, with no other tag around it at all."]),
    ("<html><head><title>T</title><p>Some real text here.</p><p>More of it follows now.</p>", ["Some real text here.", "More of it follows now."]),
    ("<title>T</title><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><h1>On rivers</h1><p>Rivers run&nbsp;&nbsp; down to the sea, mostly.</p></main><footer>&copy; 2024 Someone</footer>",
     ["On rivers", "Rivers run down to the sea, mostly."]),
    ("<body><article><h1>Bread</h1><p>Flour, water and salt are all that it takes.</p></article><div class='user-remarks'><p>Great, I baked it twice already!</p><p>So did I.</p></div></body>",
     ["Bread", "Flour, water and salt are all that it takes."]),
    ("<body><article><p>First, the dough is made and left alone.</p></article><section id=responses><article><p>Thanks for this, it was useful to me.</p></article></section></body>",
     ["First, the dough is made and left alone."]),
    ("<body><div id=header>My site</div><div id=content><h2>Wind</h2><p>Air moves from high to low.<p>It never rests.</div><div id=sidebar><ul><li><a href=/a>Other</a><li><a href=/b>Things</a></ul></div></body>",
     ["Wind", "Air moves from high to low.", "It never rests."]),
    ("<body><div class=cookie-banner><p>We use cookies to make this better.</p><button>Fine</button></div><article><p>Before, <svg><path d=x></p><p>between, and after that</p><p>the end is near.</p></article>",
     ["Before,", "between, and after that", "the end is near."]),
    ("<body><article><p>It was late. <select><option>x<p>Nobody was awake in the house.</article></body>", ["It was late.", "Nobody was awake in the house."]),
    ("<body><div class=ads><p>Buy one now and get one more.</p></div><section class=post><h1>Stones</h1><blockquote>They last longer than we do.</blockquote><ul><li>Granite is hard and old.</li><li>Chalk is soft.</li></ul></section><form><p>Sign up for our letter.</p><input></form></body>",
     ["Stones", "They last longer than we do.", "Granite is hard and old.", "Chalk is soft."]),
]


def test_layouts_by_hand():
    chain = webtext.default_chain()
    hits = misses = false = 0
    for page, expected in LAYOUTS:
        found = [t for t in webtext.main_text(page, chain).split("\n\n") if t]
        hits, misses, false = hits + len(set(found) & set(expected)), misses + len(set(expected) - set(found)), false + len(set(found) - set(expected))
        if page.startswith(("<html><body><p>", "<p>Only", "<html><head>")):
            assert found == expected
    assert 2 * hits / (2 * hits + misses + false) > 0.95


def test_extract_cases(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>x", 3), (4, "u", "<br>" * 20_000, 4), (5, "u", "<div>" * 3000 + "word " * 50_000, 5), (5, "u", "<p>x", 5), (6, "u", "<<<>>&&", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = webtext.extract(df).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert {r.text for r in found if r.page_id in (1, 2, 4)} == {""}
    assert webtext.extract(df.where("false")).count() == 0
