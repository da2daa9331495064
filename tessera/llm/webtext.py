"""Main text of web pages by a linear-chain conditional random field.

A page is read into its DOM's leaf blocks: runs of text between block-level
tags, with the tags above them. A block's features are its ancestors' tags and
the words of their class and id, and the text's length, links and ends. A chain
of two labels, article and other, has weights for features and for label pairs;
it is trained in numpy on labelled pages (made by a rule in ``labelled_pages``,
as no table of them is at hand) and decoded by Viterbi. Article blocks in page
order are the text.

Each page is read by itself in Arrow batches: no shuffle, memory of a page at a
time. The model is a dictionary of a few thousand weights, of fixed size.

Defined cases: null and empty pages, and pages without text, give an empty
text. Unclosed comments and scripts end with the page, other unclosed tags with
their parent; the tags of html, head and body may be left out. White space is
that of Unicode, U+00A0 included. Pages are read whole, whatever their length. Of
labellings that score alike the one with the earlier blocks outside the article
wins. Repeated rows each get a row; a null page_id is kept; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, pick, short_batches

_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul noscript object canvas".split()
)
#: Elements whose content is no text of the page.
_DROPPED = frozenset("script style template svg iframe select textarea title audio video".split())
#: Those whose content is not markup either.
_RAW = frozenset("script style textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element on the left ends where one of the right begins.
_ENDS = {"p": _BLOCK_TAGS - {"html", "body", "noscript", "object", "canvas"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that hold text."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)
    # The open dropped element and what is open in it; the open elements that are no blocks, by tag.
    dropped: list[str] = []
    inline: dict[str, int] = {}

    def ends_dropped(closing: str, tag: str) -> bool:
        """Whether a tag ends the dropped element's parent, and so the element, or cannot stand in the element."""
        if closing:
            return tag in ("html", "body") or inline.get(tag, 0) > 0 or any(tag == t for t, _ in stack)
        if tag == "body":
            return True
        if dropped[0] == "template" or tag not in _BLOCK_TAGS:
            return False
        if dropped[0] in ("svg", "select"):
            return "foreignobject" not in dropped
        return bool(stack) and tag in _ENDS.get(stack[-1][0], ()) and _BLOCK_TAGS.isdisjoint(dropped)

    def close() -> None:
        nonlocal linked, in_link
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())  # white space of any kind, U+00A0 too
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            parts.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:  # a bare <
            if not dropped:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = n if end is None else end.end()
            continue
        if dropped:
            if closing and tag in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
                continue
            if not ends_dropped(closing, tag):
                if not closing and tag not in _VOID and not attributes.endswith("/"):
                    dropped.append(tag)
                continue
            dropped.clear()
        if tag in _DROPPED:
            if not closing and not attributes.endswith("/"):
                dropped.append(tag)
            continue
        if tag not in _BLOCK_TAGS and tag not in _VOID:
            inline[tag] = max(0, inline.get(tag, 0) + (-1 if closing else 1))
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append("\n")
        elif tag in _BLOCK_TAGS:
            close()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                in_link = False
            elif tag not in _VOID:
                while stack and tag in _ENDS.get(stack[-1][0], ()):
                    stack.pop()
                stack.append((tag, attributes.strip()))
    close()
    return out


#: Words of class and id by what they tell.
_FAMILIES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip topbar toolbar",
    "head": "header head masthead logo brand topbar branding",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside related recommended widget widgets popular trending more rail teaser teasers tags tag archive archives recirc",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola commercial",
    "note": "cookie cookies consent gdpr notice notices alert alerts warning message popup modal overlay toast paywall disclaimer banner announcement",
    "form": "form search login signin signup register subscribe subscription newsletter contact input email",
    "talk": "comment comments commentlist reply replies respond response responses discussion discuss disqus feedback reader readers reviews thread threads forum "
    "remark remarks opinion opinions talkback guestbook chat conversation conversations say says thoughts",
    "share": "share sharing social follow like tweet buttons author byline bio meta date",
    "hide": "hidden none sr only visually invisible",
    "body": "article content post entry body main story text page prose paragraph blog news articlebody maincontent",
}
_FAMILY = {w: f for f, words in _FAMILIES.items() for w in words.split()}


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    out = {f"depth={min(len(path), 6)}", f"tag={path[-1][0] if path else ''}"}
    inner: set[str] = set()
    for k, (tag, attributes) in enumerate(path):
        out.add(f"under={tag}")
        words: set[str] = set()
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                words.add("hidden")
            elif name not in ("style", "aria-hidden"):
                words |= {t.lower() for t in _TOKEN.findall(value)}
        families = {_FAMILY[w] for w in words if w in _FAMILY}
        out |= {f"word={w}" for w in words} | {f"kind={f}" for f in families}
        if tag not in ("html", "body"):
            inner = families or inner
        if k == len(path) - 1:
            out |= {f"own={f}" for f in families}
    out |= {f"near={f}" for f in inner}
    if not any(f.startswith("kind=") for f in out):
        out.add("kind=")
    return tuple(sorted(out))


def _text_features(b: Block, k: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    size = min(5, words.bit_length())
    links = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
    ended = b.text[-1] in ".!?…\"”»:;)"
    tag = b.path[-1][0] if b.path else ""
    out = [f"size={size}", f"links={links}", f"ended={ended}", f"size,links={size},{links}", f"tag,size={tag},{size}", f"tag,links={tag},{links}", f"commas={min(3, b.text.count(','))}"]
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    if "©" in b.text:
        out.append("marks")
    return out


@dataclass
class Chain:
    """Log odds of label 1 by feature; scores of label pairs, and of the first and last label."""

    weight: dict[str, float] = field(default_factory=dict)
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    ends: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def odds(self, seen: list[Block], paths: dict) -> list[float]:
        w, out = self.weight, []
        for k, b in enumerate(seen):
            s = paths.get(b.path)
            if s is None:
                if len(paths) > 50_000:
                    paths.clear()
                s = paths[b.path] = sum(w.get(f, 0.0) for f in _path_features(b.path))
            out.append(s + sum(w.get(f, 0.0) for f in _text_features(b, k, len(seen))))
        return out

    def decode(self, odds: list[float]) -> list[int]:
        """The labels of greatest total score (Viterbi)."""
        if not odds:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        (s0, s1), (e0, e1) = self.ends.tolist()
        a, b, back = s0, s1 + odds[0], []
        for o in odds[1:]:
            f0, f1 = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if f0 else 1, 0 if f1 else 1))
            a, b = (a + p00 if f0 else b + p10), (a + p01 if f1 else b + p11) + o
        label = 0 if a + e0 >= b + e1 else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _marginals(odds: np.ndarray, pair: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each block, and of each label pair, summed."""
    n = len(odds)
    unary = np.stack([np.zeros(n), odds], 1)
    fwd, bwd = np.empty((n, 2)), np.empty((n, 2))
    fwd[0] = ends[0] + unary[0]
    for t in range(1, n):
        fwd[t] = unary[t] + np.logaddexp(fwd[t - 1, 0] + pair[0], fwd[t - 1, 1] + pair[1])
    bwd[-1] = ends[1]
    for t in range(n - 2, -1, -1):
        after = unary[t + 1] + bwd[t + 1]
        bwd[t] = np.logaddexp(pair[:, 0] + after[0], pair[:, 1] + after[1])
    total = np.logaddexp(*(fwd[-1] + bwd[-1]))
    one = np.exp(fwd[:, 1] + bwd[:, 1] - total)
    if n == 1:
        return one, np.zeros((2, 2))
    both = fwd[:-1, :, None] + pair[None] + (unary[1:] + bwd[1:])[:, None, :] - total
    return one, np.exp(both).sum(0)


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.3, shrink: float = 1e-4, seed: int = 3) -> Chain:
    """Weights of greatest conditional likelihood, by Adagrad over pages."""
    names: dict[str, int] = {}
    data = []
    for seen, labels in pages:
        if seen:
            feats = [[names.setdefault(f, len(names)) for f in (*_path_features(b.path), *_text_features(b, k, len(seen)))] for k, b in enumerate(seen)]
            n = np.array([len(f) for f in feats])
            data.append((np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(seen)), n), np.array(labels)))
    w, w_seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    pair, ends = np.zeros((2, 2)), np.zeros((2, 2))
    pair_seen, ends_seen = np.full((2, 2), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            ids, row, labels = data[i]
            odds = np.bincount(row, w[ids], len(labels))
            one, both = _marginals(odds, pair, ends)
            g = np.bincount(ids, (one - labels)[row], len(names))
            met = np.unique(ids)
            g = g[met] + shrink * w[met]
            w_seen[met] += g * g
            w[met] -= rate * g / np.sqrt(w_seen[met])
            gp = both.copy()
            np.subtract.at(gp, (labels[:-1], labels[1:]), 1)
            ge = np.array([[1 - one[0], one[0]], [1 - one[-1], one[-1]]])
            ge[0, labels[0]] -= 1
            ge[1, labels[-1]] -= 1
            pair_seen += gp * gp
            ends_seen += ge * ge
            pair -= rate * gp / np.sqrt(pair_seen)
            ends -= rate * ge / np.sqrt(ends_seen)
    return Chain({f: float(w[i]) for f, i in names.items()}, pair, ends)


def labelled_pages(n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages made by rule, with a label for each block: 1 in the article, else 0.

    Layouts, tags, class names, lengths and malformed markup vary; words are
    random, so that only structure and form can be learned.
    """
    rng = random.Random(seed)

    def sentence(low: int = 2, high: int = 18) -> str:
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéäñ", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        for i in range(len(words) - 1):
            if rng.random() < 0.1:
                words[i] += ","
        return " ".join(words).capitalize() + rng.choice("....!?")

    def text(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def words(low: int = 1, high: int = 3) -> str:
        return sentence(low, high)[:-1]

    def link(t: str) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{t}</a>'

    def named(families: str) -> str:
        w = rng.choice([x for f in families.split() for x in _FAMILIES[f].split()])
        w = rng.choice([w, w, w + "-" + rng.choice(("box", "list", "wrap", "block", "inner")), rng.choice(("site", "page", "main")) + "-" + w])
        return f' {rng.choice(("class", "class", "id"))}="{w}"'

    def wrap(tag: str, families: str, inner: str, plain: float = 0.0) -> str:
        return f"<{tag}{'' if rng.random() < plain else named(families)}>{inner}</{tag}>"

    def links() -> str:
        items = [link(words()) for _ in range(rng.randint(2, 9))]
        return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "".join(f"<li>{x}" for x in items)))

    def piece() -> str:
        return rng.choice((text(1, 3), sentence(), words(2, 6), links(), f"<p>{text(1, 2)}</p>", f"<p>{sentence()}</p>", f"<h3>{words()}</h3>" + links(), f"<h4>{words()}</h4><p>{text(1, 2)}</p>"))

    def nav() -> str:
        return rng.choice((wrap("nav", "nav", links(), 0.6), wrap("div", "nav", links()), wrap("ul", "nav", "".join(f"<li>{link(words())}</li>" for _ in range(rng.randint(2, 8))))))

    def top() -> str:
        inner = rng.choice((link(words()), f"<h1>{words()}</h1>", f"<p>{sentence()}</p>", words())) + (nav() if rng.random() < 0.4 else "")
        return wrap(rng.choice(("header", "header", "div")), "head", inner, 0) if rng.random() < 0.6 else f"<header>{inner}</header>"

    def foot() -> str:
        inner = rng.choice((f"&copy; {words()} &middot; {sentence()}", f"<p>&copy; {rng.randint(1999, 2030)} {words()}</p>", links(), text(1, 2), f"<p>{text(1, 2)}</p>"))
        return f"<footer>{inner}</footer>" if rng.random() < 0.6 else wrap("div", "foot", inner)

    def advert() -> str:
        return wrap(rng.choice(("div", "div", "div", "aside", "section", "p")), "ad", piece())

    def side() -> str:
        return f"<aside>{piece()}</aside>" if rng.random() < 0.4 else wrap(rng.choice(("div", "aside", "section")), "side", piece() + (piece() if rng.random() < 0.5 else ""))

    def note() -> str:
        return wrap(rng.choice(("div", "div", "section", "p", "dialog")), "note", rng.choice((text(1, 2), f"<p>{text(1, 3)}</p><button>{words(1, 2)}</button>", sentence())))

    def form() -> str:
        inner = f"<label>{words()}</label><input name=q><button>{words(1, 1)}</button>" + (f"<p>{sentence()}</p>" if rng.random() < 0.5 else "")
        return f"<form action=/x>{inner}</form>" if rng.random() < 0.7 else wrap("div", "form", f"<p>{sentence()}</p>" + inner)

    def talk() -> str:
        each = [rng.choice((f"<p>{text(1, 4)}</p>", f"<div>{text(1, 3)}</div>", f"<b>{words(1, 2)}</b> {text(1, 3)}", f"<li>{text(1, 2)}</li>", f"<article>{text(1, 2)}</article>")) for _ in range(rng.randint(1, 5))]
        head = f"<h3>{words()}</h3>" if rng.random() < 0.6 else ""
        return wrap(rng.choice(("div", "section", "ol", "ul", "aside")), "talk", head + "".join(wrap("div", "talk", e, 0.5) for e in each))

    def share() -> str:
        return wrap(rng.choice(("div", "ul", "p", "span", "div")), "share", rng.choice((links(), words(), sentence())))

    def hidden() -> str:
        return f"<div{rng.choice((' hidden', ' style=\"display:none\"', ' aria-hidden=\"true\"'))}>{text(1, 2)}</div>"

    boiler = (advert, advert, side, note, form, talk, share, hidden)

    def paragraph() -> str:
        t = text(1, 7) if rng.random() < 0.8 else sentence(1, 5)
        if rng.random() < 0.2:
            at = t.find(" ") + 1
            t = t[:at] + rng.choice((link(words()), f"<b>{words()}</b>", f"<em>{words()}</em>", "<b>", words() + "<br>")) + " " + t[at:]
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{t}</p>"
        if kind < 0.8:
            return f"<p>{t}"
        if kind < 0.88:
            return f"<p><b>{t}<br>"
        if kind < 0.93:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        return rng.choice((f"<blockquote>{t}</blockquote>", f"<div>{t}</div>", f"<h2>{words(1, 5)}</h2>", f"<pre>{t}</pre>", f"<table><tr><td>{words()}</td><td>{sentence()}</td></tr></table>"))

    out = []
    for _ in range(n):
        mark = lambda s: f"\x01{s}\x02"  # noqa: E731  article blocks are told by marks around their text
        body = [f"<h1>{mark(rng.choice((sentence(2, 9), sentence(2, 9)[:-1])))}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.choice((1, 1, 2, 4, 7, 12, 20))):
            body.append(re.sub(r">([^<]+)", lambda m: ">" + mark(m[1]), paragraph()))
            if rng.random() < 0.06:
                body.append(rng.choice(boiler)())
        if rng.random() < 0.25:
            body.append(rng.choice((share, talk, side, form, advert))())
        inner = "".join(body)
        kind = rng.random()
        if kind < 0.45:
            inner = f"<article>{inner}</article>"
        elif kind < 0.6:
            inner = f"<main>{inner}</main>"
        elif kind < 0.85:
            inner = wrap(rng.choice(("div", "div", "section", "article")), "body", inner)
        if rng.random() < 0.3:
            inner = wrap("div", "body", inner, 0.5)
        alone = rng.random() < 0.2
        if alone:  # a plain page: an article and nothing else
            inner = "".join(re.sub(r">([^<]+)", lambda m: ">" + mark(m[1]), paragraph()) for _ in range(rng.choice((1, 1, 2, 2, 3, 5, 8))))
            inner = rng.choice((inner, f"<div>{inner}</div>", f"<main>{inner}</main>"))
        before = [] if alone else [rng.choice((nav, nav, top, top, advert, note, form, side))() for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4)))]
        after = [] if alone else [rng.choice((foot, foot, talk, side, nav, advert, form, note))() for _ in range(rng.choice((0, 1, 1, 2, 2, 3)))]
        page = f"{''.join(before)}{inner}{''.join(after)}"
        page = rng.choice((f"<html><head><title>{words()}</title></head><body>{page}</body></html>",) * 3 + (f"<html><head><title>{words()}</title>{page}", page))
        seen = blocks(page)
        labels = [int("\x01" in b.text) for b in seen]
        for b in seen:
            b.text = b.text.replace("\x01", "").replace("\x02", "").strip() or "x"
            b.linked = min(b.linked, len(b.text))
        out.append((seen, labels))
    return out


TRAINING_PAGES = 1500


@lru_cache(maxsize=2)
def default_chain(n: int = TRAINING_PAGES) -> Chain:
    return train(labelled_pages(n))


def main_text(page: str, chain: Chain, paths: dict | None = None) -> str:
    """The article blocks of a page, joined by an empty line."""
    seen = blocks(page)
    labels = chain.decode(chain.odds(seen, {} if paths is None else paths))
    return "\n\n".join(b.text for b, label in zip(seen, labels, strict=True) if label)


def _extract(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    paths: dict = {}
    for batch in batches:
        texts = [main_text(h or "", chain, paths) for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = chain or default_chain()
    short_batches(pages.sparkSession)
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = rows.mapInArrow(lambda it: frugal(_extract(it, model)), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
