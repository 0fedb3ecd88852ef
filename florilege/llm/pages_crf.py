"""Main text of pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into blocks: runs of text between block-level tags, with the open tags above them. Each block has
features of its ancestor tags and of its text; the chain labels blocks as main text or not and is decoded by Viterbi.
It is trained on labelled pages: a bounded sample of the given pages whose own semantic tags tell what is main text, each
also re-dressed in other layouts (other tags and class names, sidebars, notices, comments, forms around the same
blocks), so that no single tag is relied on.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pages that the field is trained on, by hash of their id.
SAMPLE = 120
#: Most characters of a page that the fit reads; longer pages are extracted like all others.
LONGEST = 60_000
#: What a page must hold to teach.
HAS_MAIN = r"(?i)<(?:article|main)[\s>]"
BUCKETS = 1 << 12
#: Tags that begin and end a block, tags whose content is no text, tags without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of the key ends an open tag of the value.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_ENDS_P = BLOCK_TAGS - {"body", "html", "head", "option", "optgroup", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_MARK = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text, the open tags above it, the words of their class and id, and the share of linked text."""

    text: str
    tags: tuple[str, ...]
    marks: frozenset[str]
    linked: float
    hidden: bool = False


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of the whole page in order; markup that breaks off is closed at the end."""
    page = page or ""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    pieces: list[str] = []
    linked, at, depth_a = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = "".join(pieces)
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            marks = frozenset().union(*(m for _, m, _ in stack)) if stack else frozenset()
            blocks.append(Block(text, tuple(t for t, _, _ in stack), marks, min(1.0, linked / max(1, len(text))), any(h for _, _, h in stack)))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if depth_a:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal depth_a
        while len(stack) > to:
            if stack.pop()[0] == "a":
                depth_a -= 1

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in BLOCK_TAGS
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if block:
                        flush()
                    pop(i)
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in SILENT_TAGS and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if block:
                flush()
            continue
        if block:
            flush()
            ends = _ENDS.get(name, set()) | ({"p"} if name in _ENDS_P else set())
            for i in range(len(stack) - 1, -1, -1):
                # a <p> may hold open inline tags, which end with it
                if stack[i][0] in ends:
                    pop(i)
                elif stack[i][0] in BLOCK_TAGS:
                    break
        if name not in VOID_TAGS and not m[3].rstrip().endswith("/"):
            marks = frozenset(w for found in _MARK.findall(m[3]) for w in _PART.findall(" ".join(found).lower())) if m[3] else frozenset()
            stack.append((name, marks, bool(m[3] and _HIDDEN.search(m[3]))))
            depth_a += name == "a"
    flush()
    return blocks


_CACHE: dict[tuple, list[int]] = {}


def hashed(key: tuple, names: Callable[..., Iterable[str]]) -> list[int]:
    """Places of the features ``names(*key)``; keys that recur are kept."""
    got = _CACHE.get(key)
    if got is None:
        got = [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names(*key)]
        if len(_CACHE) < 50_000:
            _CACHE[key] = got
    return got


def _of_tags(tags: tuple[str, ...], marks: frozenset[str], hidden: bool) -> list[str]:
    return ["bias", *sorted({f"a:{t}" for t in tags if t in BLOCK_TAGS}), *sorted(f"m:{w}" for w in marks), *(["hidden"] if hidden else [])]


def _of_shape(tag: str, size: int, link: int, end: str) -> list[str]:
    return [f"s{size}", f"l{link}", f"e{end}", f"s{size}l{link}", f"s{size}e{end}", f"t:{tag}", f"t:{tag}:{size}:{link}"]


def _of_place(noise: bool, digits: int, twice: int, place: str, before: str, after: str) -> list[str]:
    return [f"noise{noise}", f"digits{digits}", f"twice{twice}", place, f"before:{before}", f"after:{after}"]


_NOISE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign ?(?:in|up)|log ?in|newsletter|advert|sponsor|share this|privacy|terms of|read more|related|comments?\b|reply|posted by|follow us|menu|search", re.I)


def features(blocks: list[Block]) -> list[list[int]]:
    """Hashed features of every block: tags, class words, shape of the text, and the shape of its neighbours."""
    n, shapes, out = len(blocks), [], []
    counts: dict[str, int] = {}
    for b in blocks:
        counts[b.text] = counts.get(b.text, 0) + 1
        size = min(6, (b.text.count(" ") + 1).bit_length() - 1)
        link = 0 if b.linked == 0 else 1 if b.linked < 0.3 else 2 if b.linked < 0.8 else 3
        shapes.append((size, link, "." if b.text[-1] in ".!?…:;\"'”»" else "x"))
    beside = ["edge", *(f"{s}{k}" for s, k, _ in shapes), "edge"]
    for i, b in enumerate(blocks):
        tag = next((t for t in reversed(b.tags) if t in BLOCK_TAGS), "")
        noise = len(b.text) < 200 and _NOISE.search(b.text) is not None
        # digits in a hundred characters of the whole block
        digits = min(3, 20 * sum(map(b.text.count, "0123456789")) // max(100, len(b.text)))
        place = f"from{i}" if i < 4 else f"to{n - 1 - i}" if n - 1 - i < 4 else "inside"
        out.append(
            hashed((b.tags, b.marks, b.hidden), _of_tags)
            + hashed((tag, *shapes[i]), _of_shape)
            + hashed((noise, digits, min(2, counts[b.text] - 1), place, beside[i], beside[i + 2]), _of_place)
        )
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass(frozen=True)
class Field:
    """Weights of a two-label chain: label 1 is main text."""

    emit: np.ndarray
    step: np.ndarray

    def potentials(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[:, r].sum(axis=1) for r in rows])

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best labels by Viterbi."""
        if not rows:
            return []
        scores = self.potentials(rows).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one, back = scores[0][0], scores[0][1], []
        for e0, e1 in scores[1:]:
            b0, b1 = one + s10 > zero + s00, one + s11 > zero + s01
            back.append((b0, b1))
            zero, one = (one + s10 if b0 else zero + s00) + e0, (one + s11 if b1 else zero + s01) + e1
        label = int(one > zero)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 10, ridge: float = 2e-3, seed: int = 3) -> Field:
    """Maximum likelihood with weight decay, by averaged stochastic gradient steps with adaptive sizes over the pages."""
    emit, step = np.zeros((2, BUCKETS)), np.zeros((2, 2))
    seen_e, seen_s = np.full((2, BUCKETS), 0.1), np.full((2, 2), 0.1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(pages)):
            rows, labels = pages[k]
            n = len(rows)
            if not n:
                continue
            own = np.array([emit[:, r].sum(axis=1) for r in rows])
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = own[0]
            for i in range(1, n):
                ahead[i] = own[i] + _log_sum(ahead[i - 1][:, None] + step, 0)
            for i in range(n - 2, -1, -1):
                behind[i] = _log_sum(step + (own[i + 1] + behind[i + 1])[None, :], 1)
            whole = _log_sum(ahead[-1], 0)
            belief = np.exp(ahead + behind - whole)
            belief[np.arange(n), labels] -= 1
            slope_s = np.zeros((2, 2))
            for i in range(1, n):
                slope_s += np.exp(ahead[i - 1][:, None] + step + (own[i] + behind[i])[None, :] - whole)
                slope_s[labels[i - 1], labels[i]] -= 1
            flat = np.concatenate([np.array(r) for r in rows])
            times = np.repeat(np.arange(n), [len(r) for r in rows])
            for y in (0, 1):
                g = np.bincount(flat, weights=belief[times, y], minlength=BUCKETS) / np.sqrt(n)
                at = np.nonzero(g)[0]
                g = g[at] + ridge * emit[y, at]
                seen_e[y, at] += g * g
                emit[y, at] -= 0.3 * g / np.sqrt(seen_e[y, at])
            slope_s = slope_s / np.sqrt(n) + ridge * step
            seen_s += slope_s**2
            step = step - 0.3 * slope_s / np.sqrt(seen_s)
    return Field(emit, step)


_MAIN, _NOT = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset"}
_AD_MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsored", "promo", "cookie", "cookies", "comment", "comments", "sidebar", "newsletter", "related", "share", "social", "breadcrumb", "breadcrumbs", "notice", "popup", "menu", "navbar"}


def told(block: Block) -> int | None:
    """What the semantic tags above a block say: 1 main text, 0 not; None where the page has no main element."""
    if block.hidden or _NOT.intersection(block.tags) or _AD_MARKS & block.marks:
        return 0
    return 1 if _MAIN.intersection(block.tags) else None


def labelled(page: str | None) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page with an article or main element, else None."""
    blocks = leaf_blocks(page)
    told_all = [told(b) for b in blocks]
    return (blocks, [y or 0 for y in told_all]) if 1 in told_all else None


#: Layouts that training pages are re-dressed in: wrappers of main text, and of other parts.
_WRAPS = [("article",), ("main",), ("main", "article"), ("div.content",), ("div.post-body",), ("div.entry", "section"), ("div.article-text",), ("section.story",), ("div",), ("td",)]
_SIDES = {
    "menu": [("nav", "ul", "li"), ("div.menu", "ul", "li"), ("header", "ul", "li"), ("div.navbar",), ("ul.nav", "li"), ("div.breadcrumbs",)],
    "ad": [("div.ad",), ("aside",), ("div.banner",), ("div.sponsored",), ("aside.promo", "p")],
    "foot": [("footer",), ("div.footer",), ("footer", "p"), ("div.copyright",)],
    "side": [("aside", "p"), ("div.sidebar", "p"), ("aside", "ul", "li"), ("div.widget", "ul", "li"), ("div.related", "ul", "li")],
    "notice": [("div.notice",), ("div.cookie-banner", "p"), ("div.alert",), ("dialog", "p"), ("div.consent", "p")],
    "comment": [("section.comments", "p"), ("div.comments", "div.comment", "p"), ("div.comment-list", "ol", "li", "p"), ("div.respond", "p"), ("ul.commentlist", "li", "p")],
    "form": [("form",), ("form", "label"), ("form.newsletter", "p"), ("div.search", "form"), ("form", "fieldset", "legend")],
    "head": [("header",), ("div.header",), ("header", "p"), ("div.masthead",)],
}
_PHRASES = {
    "notice": ["We use cookies to make this site work.", "Your browser is out of date.", "This site uses cookies. Accept", "Please sign in to read on."],
    "form": ["Search", "Email address", "Subscribe", "Your name", "Send"],
    "head": ["Home", "News and views", "Welcome"],
}


def _dressed(text: str, path: tuple[str, ...], linked: float) -> Block:
    tags, marks = ["html", "body"], set()
    for part in path:
        tag, _, mark = part.partition(".")
        tags.append(tag)
        marks |= set(_PART.findall(mark))
    return Block(text, tuple(tags), frozenset(marks), linked)


def redressed(blocks: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The same main text in another layout, with parts around it made from the words of the page."""
    words = " ".join(b.text for b in blocks).split()
    phrase = lambda lo, hi: " ".join(rng.choice(words, size=int(rng.integers(lo, hi + 1))))
    pick = lambda options: options[int(rng.integers(len(options)))]
    wrap, out = pick(_WRAPS), []

    def part(kind: str, lo: int, hi: int, words_lo: int, words_hi: int, linked: float) -> None:
        path = pick(_SIDES[kind])
        for _ in range(int(rng.integers(lo, hi + 1))):
            text = pick(_PHRASES[kind]) if kind in _PHRASES and rng.random() < 0.6 else phrase(words_lo, words_hi)
            out.append((_dressed(text, path, linked if rng.random() < 0.9 else 0.0), 0))

    if rng.random() < 0.5:
        part("head", 1, 2, 1, 5, 0.0)
    if rng.random() < 0.8:
        part("menu", 2, 9, 1, 3, 1.0)
    if rng.random() < 0.4:
        part("notice", 1, 2, 5, 18, 0.0)
    if rng.random() < 0.6:
        part("ad", 1, 2, 4, 14, 0.0 if rng.random() < 0.5 else 1.0)
    main = [b for b, y in zip(blocks, labels, strict=True) if y]
    for k, b in enumerate(main):
        own = b.tags[-1] if b.tags and b.tags[-1] in {"p", "h1", "h2", "h3", "li", "blockquote", "pre", "td"} else "p"
        out.append((_dressed(b.text, (*wrap, own) if own != "li" else (*wrap, "ul", "li"), b.linked), 1))
        if k + 1 < len(main) and rng.random() < 0.06:
            out.append((_dressed(phrase(3, 14), (*wrap, *pick(_SIDES["ad"])), 0.0), 0))
    if rng.random() < 0.4:
        part("side", 1, 6, 2, 14, 1.0 if rng.random() < 0.6 else 0.0)
    if rng.random() < 0.5:
        part("comment", 1, 5, 6, 40, 0.0)
    if rng.random() < 0.4:
        part("form", 1, 3, 1, 4, 0.0)
    if rng.random() < 0.8:
        part("foot", 1, 2, 5, 16, 0.0)
    return [b for b, _ in out], [y for _, y in out]


def train_on(pages: list[str], dresses: int = 3, seed: int = 5) -> Field:
    """Fit on the pages that have a main element, each as it is and in ``dresses`` other layouts."""
    rng, rows = np.random.default_rng(seed), []
    for page in pages:
        got = labelled(page)
        if got is None:
            continue
        blocks, labels = got
        rows.append((features(blocks), labels))
        for _ in range(dresses):
            again, y = redressed(blocks, labels, rng)
            rows.append((features(again), y))
    return fit(rows)


def train(pages: DataFrame, most: int = SAMPLE, longest: int = LONGEST) -> Field:
    """Fit on at most ``most`` pages that name their main element, of ``longest`` characters at most, in the order of the
    hash of their id. The two bounds say what the fit reads, never what is extracted."""
    teach = pages.where(F.length("html").between(1, longest) & F.col("html").rlike(HAS_MAIN))
    ids = teach.select(F.col("page_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(most).distinct()
    rows = teach.select(F.col("page_id").alias("_id"), "html").join(F.broadcast(ids), "_id").orderBy(F.xxhash64("_id"), "html").limit(most)
    return train_on([r.html for r in rows.collect()])


def main_text(page: str | None, model: Field) -> str:
    """The blocks that the chain calls main text, joined by two line feeds."""
    blocks = leaf_blocks(page)
    labels = model.decode(features(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y and not b.hidden)


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null and empty html and pages without main text have empty text.

    Equal pages have equal texts; other columns are not read; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda h: main_text(h, model))

    out = pages.select("page_id", "url", texts(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Fit on a bounded sample of ``pages`` and extract all of them."""
    return extract(pages, train(pages))
