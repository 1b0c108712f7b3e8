r"""Operator 1: main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks: the runs of text between block-level tags.
Each block has features of its ancestors (tags, words of their class, id and
role), of its own tag and of its text (length, share of text in links, end mark,
place in the page).  A conditional random field over the sequence of blocks
labels each as main text or not; decoding is by Viterbi.  The main blocks,
with character references decoded and white space turned into single spaces,
are joined in page order by one space.

Training: maximum likelihood on ``LABELLED_PAGES`` labelled pages.  These are laid out by
``labelled_page`` from a seed: article, menu, header, footer, sidebar, notice, advert,
form, comment and link-list blocks in semantic, class-named and plain layouts, each
block with its label.  The model is a bounded set of weights, sent to the
executors with the task.

Scale: one pass without a shuffle; a page is the unit of work, its parsing is
linear in its length, and nothing is kept across pages.

Defined results: null and empty html give the empty text; scripts, styles,
comments, doctypes, head and other raw elements have no text; an unclosed comment,
script or style runs to the end of the page, as in browsers; unclosed or stray
tags are tolerated; a head without its end tag ends, as in browsers, at the first tag
or text that cannot stand in a head; null ids and urls pass through; repeated rows are each
extracted; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.llm.common import in_slices

LABELLED_PAGES = 800
SEED = 7

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; raw ones are not parsed.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head noscript template svg math select object canvas audio video".split())
#: Tags that leave an open head open.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
_BARRIER = frozenset("html table td th caption button object".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr li main menu nav ol p pre section table ul dd dt".split()
)
#: A start tag of the key ends an open element of the value (same list only).
_ENDS = {"li": ("li", "ul", "ol"), "dt": ("dt", "dl", "dl"), "dd": ("dd", "dl", "dl"), "tr": ("tr", "table", "table"), "td": ("td", "tr", "table"), "th": ("th", "tr", "table"), "option": ("option", "select", "select")}
_SECTIONS = frozenset("article main nav aside header footer section form table dialog".split())

#: Words in class, id and role that say what an element is for.
_HINTS = (
    "ad ads adv advert advertisement sponsor sponsored promo promotion banner sidebar aside side widget rail menu nav navbar"
    " navigation breadcrumb breadcrumbs header masthead topbar top branding logo footer bottom copyright legal comment comments reply replies"
    " respond discussion disqus form search login signup subscribe newsletter cookie cookies consent notice alert warning modal"
    " popup overlay share sharing social related recommended recommendation more popular trending tags meta byline author pager"
    " pagination toolbar tools skip toc article post entry story content main body text blog single page wrapper container"
    " contentinfo complementary dialog feedback review reviews message messages disclaimer"
).split()
_HINT_SET = frozenset(_HINTS)
_LONG_HINTS = [h for h in _HINTS if len(h) >= 6]
_NAME = re.compile(r"[A-Za-z]+")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hints(attrs: str) -> list[str]:
    out = []
    for m in _ATTR.finditer(attrs):
        for w in _NAME.findall(_CAMEL.sub(" ", m.group(2) or m.group(3) or m.group(4) or "")):
            w = w.lower()
            if w in _HINT_SET:
                out.append("has:" + w)
            else:
                out += ["has:" + h for h in _LONG_HINTS if h in w][:2]
    return out


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the part of it inside links, its context."""

    text: str
    linked: int
    tag: str
    near: str
    hint: str
    above: frozenset[str]


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; one scan, linear in the page."""
    out: list[Block] = []
    none: frozenset[str] = frozenset()
    # per open element: tag, inherited features, nearest block tag, nearest section, nearest hint, hidden
    stack: list[tuple[str, frozenset[str], str, str, str, bool]] = [("", none, "", "", "", False)]
    opened: dict[str, int] = {}
    p_at: list[int] = []
    barrier_at: list[int] = [0]
    inherited: dict[tuple, frozenset[str]] = {}
    buf: list[str] = []
    links = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                _, above, tag, near, hint, hidden = stack[-1]
                if not hidden:
                    out.append(Block(text, linked, tag, near, hint, above))
            buf.clear()
        linked = 0

    def pop_to(n: int) -> None:
        """Leave n elements open."""
        nonlocal links
        if any(x[0] not in _INLINE for x in stack[n:]):
            flush()
        while len(stack) > n:
            tag = stack.pop()[0]
            opened[tag] -= 1
            if tag == "a":
                links -= 1
            elif tag == "p":
                p_at.pop()
            elif tag in _BARRIER:
                barrier_at.pop()

    def close_head() -> None:
        while opened.get("head"):
            n = len(stack) - 1
            while stack[n][0] != "head":
                n -= 1
            pop_to(n)

    def in_head() -> bool:
        return bool(opened.get("head")) and not opened.get("noscript") and not opened.get("template")

    at, size = 0, len(page)
    quotes = True  # quoted attribute values may hold '>'
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = page[at:lt]
            if in_head() and not piece.isspace():
                close_head()
            buf.append(piece)
            if links:
                linked += len(piece)
        if lt >= size:
            break
        m = _TAG_NAME.match(page, lt + 1)
        if not m:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                if in_head():
                    close_head()
                buf.append("<")
                at = lt + 1
            continue
        name = m.group().lower()
        end = _TAG_END.match(page, m.end()) if quotes else None
        if end:
            at = end.end()
        else:
            quotes = False
            gt = page.find(">", m.end())
            at = size if gt < 0 else gt + 1
        if name[0] == "/":
            name = name[1:]
            if opened.get(name):
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                pop_to(n)
            elif name == "br":
                buf.append(" ")
            elif name not in _INLINE:
                flush()
            continue
        if name not in _IN_HEAD and (in_head() or name == "body" and not opened.get("template")):
            close_head()
        if name == "br":
            buf.append(" ")
            continue
        if name in _RAW:
            flush()
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not close:
                break
            gt = page.find(">", close.end())
            at = size if gt < 0 else gt + 1
            continue
        block = name not in _INLINE
        if block:
            flush()
            if name in _CLOSES_P and p_at and p_at[-1] > barrier_at[-1]:
                pop_to(p_at[-1])
            ends = _ENDS.get(name)
            if ends and opened.get(ends[0]):
                n = len(stack) - 1
                while n and stack[n][0] != ends[0] and stack[n][0] not in ends[1:]:
                    n -= 1
                if n and stack[n][0] == ends[0]:
                    pop_to(n)
        if name in _VOID:
            continue
        tag, above, own, near, hint, hidden = stack[-1]
        attrs = page[m.end() : at]
        if block:
            extra = _hints(attrs) if "=" in attrs else ()
            key = (above, name, *extra)
            got = inherited.get(key)
            if got is None:
                got = inherited[key] = above | {"in:" + name, *extra}
            hint = extra[0][4:] if extra else name if name in _SECTIONS else hint
            stack.append((name, got, name, name if name in _SECTIONS else near, hint, hidden or name in _HIDDEN))
        else:
            stack.append((name, above, own, near, hint, hidden))
        opened[name] = opened.get(name, 0) + 1
        if name == "a":
            links += 1
        elif name == "p":
            p_at.append(len(stack) - 1)
        elif name in _BARRIER:
            barrier_at.append(len(stack) - 1)
    flush()
    return out


def _bucket(n: int) -> int:
    return min(8, int(math.log2(n + 1)))


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of every block of a page."""
    out = []
    headed = False
    last = max(len(blocks) - 1, 1)
    for i, b in enumerate(blocks):
        t = b.text
        words = t.count(" ") + 1
        share = b.linked / max(len(t), 1)
        headed = headed or b.tag == "h1"
        fs = list(b.above)
        fs += [
            "bias",
            "tag:" + b.tag,
            "near:" + (b.near or "-"),
            "hint:" + (b.hint or "-"),
            f"words:{_bucket(words)}",
            "links:" + ("none" if share == 0 else "few" if share < 0.3 else "half" if share < 0.7 else "all"),
            "end:" + ("stop" if t[-1] in ".!?…。" else "other"),
            f"place:{4 * i // (last + 1)}",
            "headed" if headed else "unheaded",
        ]
        if words > 12 and share < 0.3:
            fs.append("prose")
        if "©" in t:
            fs.append("copyright")
        out.append(fs)
    return out


@dataclass
class Crf:
    """Two labels (0 other, 1 main): weights of label 1 against 0, transitions."""

    weights: dict[str, float] = field(default_factory=dict)
    trans: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels (Viterbi); ties go to main text."""
        if not blocks:
            return []
        get = self.weights.get
        (a00, a01), (a10, a11) = self.trans
        back = []
        v0, v1 = self.start
        for i, fs in enumerate(block_features(blocks)):
            e = sum([get(f, 0.0) for f in fs])
            if i == 0:
                v1 += e
                continue
            p0, p1 = (1, v1 + a10) if v1 + a10 >= v0 + a00 else (0, v0 + a00)
            q0, q1 = (1, v1 + a11) if v1 + a11 >= v0 + a01 else (0, v0 + a01)
            back.append((p0, q0))
            v0, v1 = p1, q1 + e
        label = 1 if v1 >= v0 else 0
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return " ".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 3e-4) -> Crf:
    """Maximum-likelihood weights, by Adam on the exact gradient (forward and
    backward sums over all pages at once, padded to the longest)."""
    names: dict[str, int] = {}
    rows, cols, n_t = [], [], max(len(y) for _, y in pages)
    labels = np.zeros((len(pages), n_t), dtype=int)
    mask = np.zeros((len(pages), n_t), dtype=bool)
    for p, (blocks, y) in enumerate(pages):
        for t, fs in enumerate(block_features(blocks)):
            ids = {names.setdefault(f, len(names)) for f in fs}
            rows += [p * n_t + t] * len(ids)
            cols += ids
        labels[p, : len(y)] = y
        mask[p, : len(y)] = True
    rows, cols = np.asarray(rows), np.asarray(cols)
    n_f = len(names)
    theta = np.zeros(n_f + 6)  # weights, transitions, start
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    x = labels * mask
    pair_mask = mask[:, 1:]
    seen_trans = np.array(
        [[((labels[:, :-1] == a) & (labels[:, 1:] == b) & pair_mask).sum() for b in (0, 1)] for a in (0, 1)], dtype=float
    )
    seen_start = np.array([(labels[:, 0] == 0).sum(), (labels[:, 0] == 1).sum()], dtype=float)
    seen_w = np.bincount(cols, weights=x.reshape(-1)[rows], minlength=n_f)
    for step in range(1, rounds + 1):
        w, trans, start = theta[:n_f], theta[n_f : n_f + 4].reshape(2, 2), theta[n_f + 4 :]
        e = np.zeros((len(pages), n_t, 2))
        e[:, :, 1] = np.bincount(rows, weights=w[cols], minlength=len(pages) * n_t).reshape(len(pages), n_t)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, n_t):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(n_t - 2, -1, -1):
            nxt = np.logaddexp(trans[:, 0] + (e[:, t + 1, 0] + beta[:, t + 1, 0])[:, None], trans[:, 1] + (e[:, t + 1, 1] + beta[:, t + 1, 1])[:, None])
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, beta[:, t + 1])
        gamma = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair_mask[:, :, None, None]
        grad = np.concatenate(
            [
                seen_w - np.bincount(cols, weights=gamma[:, :, 1].reshape(-1)[rows], minlength=n_f),
                (seen_trans - pair.sum((0, 1))).reshape(-1),
                seen_start - gamma[:, 0].sum(0),
            ]
        ) / len(pages) - ridge * theta
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    w, trans, start = theta[:n_f], theta[n_f : n_f + 4].reshape(2, 2), theta[n_f + 4 :]
    return Crf({f: float(w[i]) for f, i in names.items()}, trans.tolist(), start.tolist())


# --- labelled pages -----------------------------------------------------------

_SYLLABLES = "an er on th re in ti st en al ou le de ch ar un ve to ra mi so la ko be zu ei".split()


class _Writer:
    """Writes a page block by block; a block's label is carried by a private
    mark at the start of its text, so labels come from the parsed page itself."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.html = rng, []

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        n = r.randint(lo, hi)
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))

    def sentences(self, lo: int, hi: int) -> str:
        return ". ".join(self.words(4, 18).capitalize() for _ in range(self.rng.randint(lo, hi))) + "."

    def add(self, text: str) -> None:
        self.html.append(text)

    def text(self, label: int, text: str) -> str:
        return f"{_MARKS[label]}{text}"


_MARKS = ("\ue000", "\ue001")


def _links(w: _Writer, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="#">{w.text(0, w.words(1, 4))}</a></{tag}>' for _ in range(n))


def _named(w: _Writer, tag: str, names: str, inner: str, plain: float = 0.15) -> str:
    """An element whose class or id says its purpose, or (at times) nothing."""
    r = w.rng
    if r.random() < plain:
        return f"<div>{inner}</div>"
    name = r.choice(names.split())
    if r.random() < 0.3:
        name = f"{name}-{r.choice('box list wrap area block item'.split())}"
    return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'


def labelled_page(rng: random.Random) -> str:
    """One labelled page's html; marks at the start of each block tell its label."""
    w, r = _Writer(rng), rng
    semantic = r.random() < 0.6
    t0 = lambda lo, hi: w.text(0, w.words(lo, hi))
    s0 = lambda lo, hi: w.text(0, w.sentences(lo, hi))
    t1 = lambda lo, hi: w.text(1, w.words(lo, hi))
    s1 = lambda lo, hi: w.text(1, w.sentences(lo, hi))

    def menu() -> str:
        inner = f"<ul>{_links(w, r.randint(3, 8))}</ul>" if r.random() < 0.8 else _links(w, r.randint(3, 8), "div")
        return f"<nav>{inner}</nav>" if semantic else _named(w, "div", "menu nav navbar navigation topbar breadcrumb toc", inner)

    def header() -> str:
        tag = r.choice(["div", "p", "h2", "h1"])
        inner = f"<{tag}>{t0(1, 6)}</{tag}><p>{t0(1, 8)}</p>"
        return f"<header>{inner}</header>" if semantic else _named(w, "div", "header masthead branding top", inner, 0)

    def footer() -> str:
        inner = r.choice([f"&copy; {w.words(1, 3)} &middot; {w.words(2, 9)}.", w.sentences(1, 2), w.words(3, 10)])
        inner = w.text(0, inner) if r.random() < 0.5 else f"<p>{w.text(0, inner)}</p>" + (f"<p><a>{t0(1, 3)}</a></p>" if r.random() < 0.5 else "")
        return f"<footer>{inner}</footer>" if semantic else _named(w, "div", "footer bottom copyright legal contentinfo", inner, 0.1)

    def advert() -> str:
        inner = s0(1, 3) if r.random() < 0.7 else f"<p>{s0(1, 2)}</p><a>{t0(1, 4)}</a>"
        return _named(w, r.choice(["div", "aside", "section"]), "ad ads advert advertisement sponsored promo banner", inner, 0)

    def notice() -> str:
        inner = f"<p>{s0(1, 3)}</p>" if r.random() < 0.5 else s0(1, 3)
        if r.random() < 0.5:
            inner += f"<button>{t0(1, 2)}</button>"
        return _named(w, r.choice(["div", "section", "aside"]), "notice cookie cookies consent alert popup modal overlay disclaimer warning", inner, 0)

    def sidebar() -> str:
        inner = "".join(
            r.choice([f"<h3>{t0(1, 4)}</h3><ul>{_links(w, r.randint(2, 5))}</ul>", f"<p>{s0(1, 3)}</p>", f"<h4>{t0(1, 3)}</h4><p>{s0(1, 2)}</p>"])
            for _ in range(r.randint(1, 3))
        )
        return f"<aside>{inner}</aside>" if semantic and r.random() < 0.7 else _named(w, "div", "sidebar side widget rail complementary", inner, 0)

    def form() -> str:
        inner = f"<label>{t0(1, 3)}</label><input type=text><button>{t0(1, 2)}</button>"
        if r.random() < 0.5:
            inner = f"<p>{s0(1, 2)}</p>" + inner
        if r.random() < 0.3:
            inner = f"<p>{s0(1, 2)}</p><form>{inner}</form>"
            return _named(w, "div", "newsletter subscribe signup login search", inner, 0)
        return f"<form>{inner}</form>" if r.random() < 0.8 else _named(w, "div", "search login newsletter subscribe signup form", inner, 0)

    def comments() -> str:
        one = lambda: _named(w, r.choice(["div", "article", "li"]), "comment reply message", f"<p>{s0(1, 5)}</p>" if r.random() < 0.7 else f"<b>{t0(1, 2)}</b><p>{s0(1, 4)}</p>", 0.3)
        inner = (f"<h2>{t0(1, 3)}</h2>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        return _named(w, r.choice(["div", "section", "ul", "aside"]), "comments discussion disqus replies respond feedback reviews", inner, 0)

    def related() -> str:
        if r.random() < 0.3:
            return _named(w, "div", "share sharing social tags meta byline author pager tools toolbar", f"{t0(1, 5)} <a>{w.words(1, 2)}</a>", 0)
        return _named(w, r.choice(["div", "section", "aside"]), "related recommended more popular trending share social tags pager", f"<ul>{_links(w, r.randint(2, 6))}</ul>", 0.2)

    def prose() -> str:
        body = s1(1, 8)
        if r.random() < 0.25:
            cut = body.split(" ")
            k = r.randrange(len(cut))
            cut[k] = f"<a href='#'>{cut[k]}</a>" if k else cut[k]
            body = " ".join(cut)
        if r.random() < 0.2:
            body = f"<b>{body}" if r.random() < 0.5 else f"<em>{body}</em>"
        return f"<p>{body}" + ("</p>" if r.random() < 0.85 else "<br>")

    def article() -> str:
        parts = [f"<h1>{t1(2, 12)}</h1>"] if r.random() < 0.85 else []
        if semantic and parts and r.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.randint(1, 10)):
            x = r.random()
            if x < 0.58:
                parts.append(prose())
            elif x < 0.64:
                parts.append(f"<div>{s1(1, 5)}</div>")
            elif x < 0.68:
                parts.append(f"<section>{prose()}</section>")
            elif x < 0.72:
                parts.append(f"{s1(1, 4)}<br><br>" if parts else prose())
            elif x < 0.78:
                parts.append(f"<p>{t1(1, 6)}</p>")
            elif x < 0.82:
                parts.append(f"<h2>{t1(1, 6)}</h2>")
            elif x < 0.85:
                parts.append("<ul>" + "".join(f"<li>{t1(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                parts.append(f"<blockquote>{s1(1, 3)}</blockquote>")
            elif x < 0.88:
                parts.append(f"<pre>{t1(3, 20)}</pre>")
            elif x < 0.89:
                parts.append("<table><tr>" + "".join(f"<td>{t1(1, 4)}</td>" for _ in range(r.randint(2, 4))) + "</tr></table>")
            elif x < 0.94:
                parts.append(advert())
            else:
                parts.append(r.choice([related, notice, form, sidebar])())
        inner = "".join(parts)
        x = r.random()
        if semantic and x < 0.75:
            inner = f"<article>{inner}</article>"
            return f"<main>{inner}</main>" if r.random() < 0.3 else inner
        if semantic:
            return f"<main>{inner}</main>"
        if x < 0.15:
            return f"<div>{inner}</div>"
        if x < 0.25:
            return f"<table><tr><td>{inner}</td></tr></table>"
        return _named(w, "div", "article post entry story content main body text single", inner, 0)

    before = [f() for f in (header, menu, notice, advert, form) if r.random() < 0.55]
    after = [f() for f in (related, comments, advert, sidebar, form, notice) if r.random() < 0.4]
    if r.random() < 0.4:
        before.insert(r.randrange(len(before) + 1), sidebar())
    main = article() if r.random() < 0.97 else ""
    body = "".join([*before, main, *after, footer() if r.random() < 0.85 else ""])
    if r.random() < 0.4:
        body = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{w.words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a marked page, the marks taken out."""
    blocks = leaf_blocks(page)
    labels = []
    for b in blocks:
        labels.append(1 if _MARKS[1] in b.text else 0)
        b.text = b.text.replace(_MARKS[0], "").replace(_MARKS[1], "")
    return blocks, labels


_model: Crf | None = None


def default_model() -> Crf:
    """The model trained on the labelled pages (once per process)."""
    global _model
    if _model is None:
        rng = random.Random(SEED)
        pages = [labelled_blocks(labelled_page(rng)) for _ in range(LABELLED_PAGES)]
        _model = train([p for p in pages if p[0]])
    return _model


def _text_batches(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = [model.main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extracted(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_text_batches(model or default_model()), "page_id long, url string, text string, n_chars long")
