"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags.  Every block
is a vector of its tag path (hashed tags, classes and ids of its ancestors), its
words (hashed) and a few counts; a bidirectional LSTM reads the page's blocks in
order and labels each as main text or not, so a block's neighbours decide as well
as its own markup.  Main blocks are joined by an empty line.

The labeller is trained here, on pages that ``training_page`` writes by rule: the
usual parts of pages in many arrangements, half of them with class names that say
nothing.  ``TRAIN_PAGES`` bounds them; training takes a few seconds on the driver, is
the same in every run, and its weights (under 100 kB) are broadcast.

Edge cases: null and empty html give an empty text; html without main text gives an
empty text; unclosed and stray tags are tolerated; character references are decoded;
white space inside a block becomes one space; comments, scripts, styles and markup
never are text; of an element whose content is no text, but that nothing closes, only
the tag is skipped (script and style run to the end); nothing is cut off from long pages; repeated rows are treated alike; a block whose score lies exactly between
both labels is no main text; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm import arrowtext

TRAIN_PAGES = 700
_HIDDEN = 16
_PATH, _WORDS, _COUNTS = 128, 32, 8
_SIZE = _PATH + _WORDS + _COUNTS

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: What may stand between a tag's name and its end; a quoted ``>`` does not end it.
_INSIDE = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Tags that do not end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text.
_RAW = frozenset("script style template noscript iframe svg object math canvas".split())
#: Of these, those that ``/>`` makes empty; and those that run to the page's end when nothing closes them.
_EMPTIED = frozenset("iframe svg object math".split())
_TO_THE_END = frozenset("script style".split())
_END_OF = {tag: re.compile(f"</{tag}", re.I) for tag in _RAW}
#: A slash that belongs to an attribute's value.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"']+/\Z")
#: What an opening tag closes when it is still open.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


@functools.lru_cache(maxsize=4096)
def _slot(token: str) -> tuple[int, float]:
    h = 2166136261
    for b in token.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    h ^= h >> 13
    return h % _PATH, 1.0 if h >> 31 else -1.0


def _attributes(raw: str) -> list[str]:
    if "=" not in raw:
        return []
    out = []
    for m in _ATTR.finditer(raw):
        out += [f".{x.lower()}" for x in _PART.findall(m[1] or m[2] or m[3] or "")]
    return out


class _Path:
    """The open elements, with a running sum of their hashed tokens; a token counts once."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()
        self.held: Counter[str] = Counter()
        self.sums = np.zeros(_PATH, np.float32)

    def push(self, tag: str, tokens: tuple[str, ...]) -> None:
        self.stack.append((tag, tokens))
        self.open[tag] += 1
        for token in tokens:
            if not self.held[token]:
                slot, sign = _slot(token)
                self.sums[slot] += sign
            self.held[token] += 1

    def pop(self) -> str:
        tag, tokens = self.stack.pop()
        self.open[tag] -= 1
        for token in tokens:
            self.held[token] -= 1
            if not self.held[token]:
                slot, sign = _slot(token)
                self.sums[slot] -= sign
        return tag

    def close(self, tag: str) -> None:
        """Ends the innermost such element and all inside it; a stray tag ends nothing."""
        while self.open[tag] and self.pop() != tag:
            pass

    def vector(self) -> np.ndarray:
        out = self.sums.copy()
        slot, sign = _slot(f"leaf:{self.stack[-1][0] if self.stack else 'body'}")
        out[slot] += sign
        return out


def blocks(page: str) -> list[tuple[str, np.ndarray, float]]:
    """(text, vector of the path, share of linked characters) of every leaf block in order.

    Time and memory are in proportion to the page, however deep its elements are
    and whatever its tags leave open.  A tag that no ``>`` outside quotes ends, ends at the next
    ``>``, and so do all tags after it.
    """
    out: list[tuple[str, np.ndarray, float]] = []
    path = _Path()
    text: list[str] = []
    linked, in_link = 0, 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html_lib.unescape("".join(text)).split())
            if whole:
                out.append((whole, path.vector(), min(1.0, linked / len(whole))))
        text.clear()
        linked = 0

    at, end, quotes = 0, len(page), True
    last = page.rfind(">")
    while at < end:
        m = _OPENING.search(page, at)
        comment = m is not None and m[0] == "<!--"
        if m is None or (m.start() > last and not comment):
            text.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if m[2] is None:
            stop = page.find("-->" if comment else ">", m.end())
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        inside = _INSIDE.match(page, m.end()) if quotes else None
        if inside is None:
            quotes = False
            at = page.index(">", m.end()) + 1
            attributes = page[m.end() : at - 1]
        else:
            at, attributes = inside.end(), inside[1]
        tag = m[2].lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        in_link = 0
        if m[1]:
            path.close(tag)
            continue
        if tag in _RAW:
            if tag in unclosed or (tag in _EMPTIED and attributes.endswith("/") and not _VALUE_SLASH.search(attributes)):
                continue
            close = _END_OF[tag].search(page, at)
            if close is None:
                if tag in _TO_THE_END:
                    break
                unclosed.add(tag)
                continue
            stop = page.find(">", close.end())
            at = end if stop < 0 else stop + 1
            continue
        closes = _CLOSES.get(tag) or (("p",) if tag in _ENDS_P else ())
        while path.stack and path.stack[-1][0] in closes:
            path.pop()
        if tag not in _VOID and not attributes.endswith("/"):
            path.push(tag, (tag, *_attributes(attributes)))
    flush()
    return out


def vectors(pages: list[list[tuple[str, np.ndarray, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """One row per block of all pages, and the pages' row bounds."""
    flat = [b for page in pages for b in page]
    bounds = np.zeros(len(pages) + 1, np.int64)
    np.cumsum([len(p) for p in pages], out=bounds[1:])
    x = np.zeros((len(flat), _SIZE), np.float32)
    if not flat:
        return x, bounds
    x[:, :_PATH] = [b[1] for b in flat]
    words = arrowtext.Words(pa.array([b[0] for b in flat]), lower=True, letters=True)
    h = words.hashes
    slot = (h % np.uint64(_WORDS)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    vec = np.bincount(words.doc * _WORDS + slot, weights=sign, minlength=len(flat) * _WORDS).reshape(-1, _WORDS)
    n = np.maximum(words.counts, 1)
    x[:, _PATH : _PATH + _WORDS] = vec / np.maximum(1e-6, np.linalg.norm(vec, axis=1))[:, None]
    sizes = np.array([len(b[0]) for b in flat], np.float32)
    stops = np.array([b[0].count(".") + b[0].count(",") for b in flat], np.float32)
    digits = np.bincount(words.doc, weights=(words.ends - words.starts) <= 2, minlength=len(flat))
    place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.repeat(np.diff(bounds), np.diff(bounds))
    c = x[:, _PATH + _WORDS :]
    c[:, 0] = np.log1p(sizes) / 4
    c[:, 1] = [b[2] for b in flat]
    c[:, 2] = np.minimum(1, stops / n * 4)
    c[:, 3] = digits / n
    c[:, 4] = place / np.maximum(1, total)
    c[:, 5] = n < 4
    c[:, 6] = n > 20
    c[:, 7] = 1.0
    return x, bounds


class Labeller:
    """A one-layer bidirectional LSTM with a logistic output for each block."""

    names = ("wx_f", "wh_f", "wx_b", "wh_b", "out", "bias")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        h = _HIDDEN
        w = {}
        for d in "fb":
            w[f"wx_{d}"] = (rng.standard_normal((_SIZE, 4 * h)) * 0.1).astype(np.float32)
            w[f"wx_{d}"][-1, h : 2 * h] += 1.0  # the last input is always 1: open forget gates
            w[f"wh_{d}"] = (rng.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
        w["out"] = (rng.standard_normal(2 * h + _SIZE) * 0.05).astype(np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return cls(w)

    @staticmethod
    def _gates(a: np.ndarray) -> tuple[np.ndarray, ...]:
        h = _HIDDEN
        s = 1.0 / (1.0 + np.exp(-np.clip(a[:, : 3 * h], -30, 30)))
        return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(a[:, 3 * h :])

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        t, n = x.shape[:2]
        pre = x @ self.w[f"wx_{d}"]
        h, c = np.zeros((n, _HIDDEN), np.float32), np.zeros((n, _HIDDEN), np.float32)
        states, tape = np.zeros((t, n, _HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            i, f, o, g = self._gates(pre[k] + h @ self.w[f"wh_{d}"])
            new = f * c + i * g
            m = mask[k][:, None]
            tc = np.tanh(new)
            if keep:
                tape.append((k, h, c, i, f, o, g, tc, m))
            h, c = h + m * (o * tc - h), c + m * (new - c)
            states[k] = h
        return states, tape

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (steps, pages, size)."""
        f, tf = self._read(x, mask, "f", keep)
        b, tb = self._read(x, mask, "b", keep)
        full = np.concatenate([f, b, x], axis=2)
        return full @ self.w["out"] + self.w["bias"][0], full, tf, tb

    def _back(self, x, tape, d, dstates, grads):
        n = x.shape[1]
        dh, dc = np.zeros((n, _HIDDEN), np.float32), np.zeros((n, _HIDDEN), np.float32)
        dpre = np.zeros((x.shape[0], n, 4 * _HIDDEN), np.float32)
        wh = self.w[f"wh_{d}"]
        for k, h, c, i, f, o, g, tc, m in reversed(tape):
            dh = dh + dstates[k]
            dho, dco = dh * m, dc * m
            do = dho * tc
            dnew = dco + dho * o * (1 - tc * tc)
            a = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
            dpre[k] = a
            grads[f"wh_{d}"] += h.T @ a
            dh = dh * (1 - m) + a @ wh.T
            dc = dc * (1 - m) + dnew * f
        grads[f"wx_{d}"] += x.reshape(-1, _SIZE).T @ dpre.reshape(-1, 4 * _HIDDEN)

    def gradients(self, x, mask, y) -> tuple[float, dict[str, np.ndarray]]:
        z, full, tf, tb = self.logits(x, mask, keep=True)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())
        dz = (mask * (p - y) / mask.sum()).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"] = np.tensordot(dz, full, axes=([0, 1], [0, 1]))
        grads["bias"][0] = dz.sum()
        dfull = dz[..., None] * self.w["out"]
        self._back(x, tf, "f", dfull[..., :_HIDDEN], grads)
        self._back(x, tb, "b", dfull[..., _HIDDEN : 2 * _HIDDEN], grads)
        return loss, grads

    def label(self, x: np.ndarray, bounds: np.ndarray, at_once: int = 128, cells: int = 1 << 15) -> np.ndarray:
        """True for main-text blocks; pages of like length are read together, ``cells`` blocks at most or one page."""
        out = np.zeros(len(x), bool)
        sizes = np.diff(bounds)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        k = 0
        while k < len(order):
            n = 1
            while n < at_once and k + n < len(order) and (n + 1) * sizes[order[k + n]] <= cells:
                n += 1
            chosen = order[k : k + n]
            k += n
            xs, mask, rows = padded(x, bounds, chosen)
            z = self.logits(xs, mask)[0]
            out[rows[mask > 0]] = z[mask > 0] > 0
        return out


def padded(x: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = bounds[chosen + 1] - bounds[chosen]
    t = np.arange(int(sizes.max()))[:, None]
    mask = (t < sizes[None, :]).astype(np.float32)
    rows = np.minimum(bounds[chosen][None, :] + t, bounds[chosen + 1][None, :] - 1)
    return x[rows] * mask[..., None], mask, rows


# --- training pages -------------------------------------------------------------

#: Class names by part of a page; every page draws one of each, or one that says nothing.
_CLASSES = {
    "main": "content post entry article story post-content entry-content article-body main-content text body-text page-content",
    "nav": "menu nav navbar navigation top-menu main-nav breadcrumb links topbar",
    "header": "header masthead site-header banner logo brand top",
    "footer": "footer site-footer bottom copyright legal foot colophon",
    "side": "sidebar aside related widget side rail recommended more-news popular trending tags",
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor",
    "notice": "cookie cookie-notice consent notice alert gdpr privacy-banner message overlay popup",
    "form": "form newsletter subscribe login search signup contact",
    "comments": "comments comment discussion replies responses comment-list disqus thread",
    "share": "share social sharing share-buttons follow buttons",
}
_PHRASES = {
    "nav": "home about contact news blog products services sign in sitemap archive".split(),
    "footer": ["© 2020 all rights reserved", "terms of use", "privacy policy", "imprint", "powered by"],
    "notice": ["we use cookies to improve your experience", "accept all cookies", "by using this site you agree to our terms", "this site uses cookies"],
    "form": ["your name", "e-mail", "subscribe to our newsletter", "password", "send", "search", "log in"],
    "comments": ["reply", "posted by", "says:", "likes", "report", "3 comments", "leave a comment"],
    "share": ["share", "tweet", "like", "follow us", "print", "email"],
    "side": ["related articles", "most read", "you may also like", "tags", "recent posts"],
    "ad": ["buy now", "sponsored", "limited offer", "advertisement"],
}


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        parts = [a + b for a in ("", *"bcdfghlmnprstvwz", "th", "sch", "qu", "ll", "ñ") for b in ("a", "e", "i", "o", "u", "en", "er", "an", "ié", "ü", "ó", "ä")]
        self.parts = [parts[k] for k in rng.choice(len(parts), 30, replace=False)]
        self.blank = rng.random() < 0.5

    def word(self) -> str:
        return "".join(self.rng.choice(self.parts, int(self.rng.integers(1, 4))))

    def words(self, lo: int, hi: int) -> str:
        out = [self.word() for _ in range(int(self.rng.integers(lo, hi)))]
        kind = self.rng.random()
        if kind < 0.04:
            out = [w for w in out for _ in range(5)]
        elif kind < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif kind < 0.14:
            out = [w + self.rng.choice(["###", "$$$", "%%%", "***", "&amp;&amp;&amp;"]) for w in out]
        return " ".join(out)

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(3, 22).capitalize() + "." for _ in range(int(self.rng.integers(lo, hi))))

    def cls(self, part: str) -> str:
        if self.rng.random() < 0.15:
            return ""
        name = self.word() if self.blank and part == "main" or self.rng.random() < 0.08 else self.rng.choice(_CLASSES[part].split())
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def maybe(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, part: str) -> str:
        return str(self.rng.choice(_PHRASES[part]))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def links(self, lo: int, hi: int, part: str = "nav") -> str:
        items = [self.link(self.pick(part) if self.maybe(0.3) else self.words(1, 4)) for _ in range(int(self.rng.integers(lo, hi)))]
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def boiler(self, part: str) -> str:
        """Markup of one part that isn't main text."""
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(part, "div")
        tag = tag if self.maybe(0.65) else "div"
        attr = self.cls(part) if tag == "div" or self.maybe(0.5) else ""
        if tag == "div" and not attr:
            attr = f' class="{self.rng.choice(_CLASSES[part].split())}"'
        if part == "nav":
            body = self.links(3, 9)
        elif part == "header":
            body = f"<{'h1' if self.maybe(0.2) else 'div'}>{self.words(1, 4)}</{'h1' if self.maybe(0) else 'div'}>" + (f"<p>{self.words(2, 8)}</p>" if self.maybe(0.5) else "") + (self.links(2, 6) if self.maybe(0.4) else "")
            body = body.replace("<h1>", "<div>")
        elif part == "footer":
            body = (f"<p>{self.pick('footer')} {self.words(1, 9)}.</p>" if self.maybe(0.4) else f"&copy; {self.words(1, 12)} &middot; {self.words(1, 8)}.") + (self.links(2, 6) if self.maybe(0.4) else "")
        elif part == "side":
            body = f"<h3>{self.pick('side') if self.maybe(0.5) else self.words(1, 4)}</h3>" + (self.links(2, 8) if self.maybe(0.6) else "") + (f"<p>{self.sentences(1, 4)}</p>" if self.maybe(0.5) else "")
        elif part == "ad":
            body = self.rng.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", self.link(self.words(2, 6)), f"{self.pick('ad')} {self.words(2, 9)}"])
        elif part == "notice":
            body = f"<p>{self.pick('notice')} {self.sentences(1, 3)}</p><button>{self.words(1, 3)}</button>" if self.maybe(0.6) else f"{self.pick('notice')} {self.words(2, 14)} {self.link(self.words(1, 3))}"
        elif part == "form":
            body = "".join(f"<label>{self.pick('form') if self.maybe(0.5) else self.words(1, 3)}</label><input name='{self.word()}'>" for _ in range(int(self.rng.integers(1, 4))))
            body += (f"<p>{self.sentences(1, 2)}</p>" if self.maybe(0.3) else "") + f"<button>{self.pick('form')}</button>"
            body += f"<select><option>{self.word()}</option><option>{self.word()}</option></select>" if self.maybe(0.2) else ""
        elif part == "comments":
            each = lambda: f"<{(t := self.rng.choice(['div', 'li', 'article']))}{self.cls('comments')}><b>{self.words(1, 3)}</b> {self.pick('comments')}<p>{self.sentences(1, 5)}</p></{t}>"
            body = f"<h3>{self.pick('comments')}</h3>" + "".join(each() for _ in range(int(self.rng.integers(1, 6))))
            attr = attr or f' class="{self.rng.choice(_CLASSES["comments"].split())}"'
        else:
            body = " ".join(self.link(self.pick("share")) for _ in range(int(self.rng.integers(2, 5))))
        return f"<{tag}{attr}>{body}</{tag}>"

    def main(self) -> list[tuple[str, bool]]:
        """Pieces of the main text with what may stand between them."""
        out = [(f"<h1>{self.words(2, 12)}</h1>", True)] if self.maybe(0.9) else []
        if self.maybe(0.2):
            out.append((self.boiler("share"), False))
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            inner = self.sentences(1, 7) if self.maybe(0.8) else self.words(1, 4) + "."
            if self.maybe(0.2):
                inner = f"<b>{inner}" + ("</b>" if self.maybe(0.5) else "<br>")
            if self.maybe(0.15):
                inner += " " + self.link(self.words(1, 3)) + " " + self.words(2, 8) + "."
            if kind < 0.72:
                out.append((f"<p>{inner}" + ("</p>" if self.maybe(0.85) else ""), True))
            elif kind < 0.82:
                out.append((f"<h2>{self.words(2, 8)}</h2>", True))
            elif kind < 0.87:
                out.append((f"<blockquote>{inner}</blockquote>", True))
            elif kind < 0.92:
                out.append(("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>", True))
            elif kind < 0.95:
                out.append((f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", True))
            elif kind < 0.97:
                out.append((f"<pre>{self.words(3, 12)}</pre>", True))
            else:
                out.append((self.boiler(str(self.rng.choice(["ad", "side", "form", "share"]))), False))
        return out


def training_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is main text."""
    w = _Writer(rng)
    before = [w.boiler(p) for p in ("notice", "header", "nav", "ad", "nav", "form") if w.maybe(0.55)]
    after = [w.boiler(p) for p in ("share", "side", "comments", "form", "ad", "nav", "notice") if w.maybe(0.4)] + ([w.boiler("footer")] if w.maybe(0.9) else [])
    aside = w.boiler("side") if w.maybe(0.3) else ""
    tag = str(rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"]))
    attr = w.cls("main") if tag != "article" or w.maybe(0.3) else ""
    outer = str(rng.choice(["", "", "div", "main"]))
    pieces = [("<title>" + w.words(2, 9) + "</title>", False), *((b, False) for b in before)]
    if outer:
        pieces.append((f"<{outer}{w.cls('main') if w.maybe(0.3) else ''}>", False))
    pieces.append((("<table><tr>" if tag == "td" else "") + f"<{tag}{attr}>", False))
    inside = w.main()
    pieces += inside
    pieces.append((f"</{tag}>" + ("</tr></table>" if tag == "td" else ""), False))
    pieces.append((aside, False))
    if outer:
        pieces.append((f"</{outer}>", False))
    pieces += [(b, False) for b in after]
    marked, head = [], True
    for text, main in pieces:
        # a marker in front of every main block's text carries the label through the parser
        marked.append(re.sub(r"(<(?:p|h1|h2|blockquote|li|td|pre)[^>]*>)", r"\1@@", text) if main else text)
        if head:
            marked.append("</head><body>")
            head = False
    cut = "" if w.maybe(0.1) else "</body></html>"
    page = '<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8">' + "".join(marked) + cut
    labels = [b[0].startswith("@@") for b in blocks(page)]
    return page.replace("@@", ""), labels


@functools.cache
def trained(pages: int = TRAIN_PAGES, epochs: int = 12, seed: int = 7) -> Labeller:
    """The labeller; Adam on batches of 60 pages."""
    rng = np.random.default_rng(seed)
    made = [training_page(rng) for _ in range(pages)]
    parsed = [(blocks(p), y) for p, y in made]
    parsed = [(b, y) for b, y in parsed if len(b) == len(y) and b]
    x, bounds = vectors([b for b, _ in parsed])
    y = np.array([v for _, ys in parsed for v in ys], np.float32)
    model = Labeller.fresh(rng)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(w) for k, w in model.w.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(parsed))
        # pages of like length together, batches in random order
        batches = [b for b in np.array_split(order[np.argsort(np.diff(bounds)[order], kind="stable")], max(1, len(order) // 60))]
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(batches)):
            xs, mask, rows = padded(x, bounds, batches[k])
            _, grads = model.gradients(xs, mask, y[rows] * mask)
            t += 1
            for n, g in grads.items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                model.w[n] = (model.w[n] - rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_blocks, n_main``."""
    held = pages.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(held.value)
        for batch in batches:
            for part in arrowtext.slices(batch, "html"):
                parsed = [blocks(h) if h else [] for h in part.column("html").to_pylist()]
                x, bounds = vectors(parsed)
                main = model.label(x, bounds)
                texts = ["\n\n".join(b[0] for b, keep in zip(p, main[bounds[k] : bounds[k + 1]], strict=True) if keep) for k, p in enumerate(parsed)]
                counts = np.add.reduceat(np.append(main, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0) if len(parsed) else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(counts, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main bigint")
