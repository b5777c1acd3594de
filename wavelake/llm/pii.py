"""Personal data in texts: patterns, and a character-level BiLSTM with a CRF for what they miss.

**Base.**  E-mail addresses, IP addresses, card and phone numbers by their usual forms, found in time that is
proportional to the text; digits are counted and checked after a match.

**Method.**  A bidirectional LSTM reads characters, a linear-chain CRF scores tag sequences (outside, begin and
inside of each kind).  Both are trained in numpy on generated windows with labelled spans: the usual forms, forms that the patterns
miss (``name at host dot org``, ``name (at) host.org``, phone numbers without ``+``, cards and addresses with other
separators) and look-alikes (dates, versions, amounts, hex and serial numbers, handles).  Overlapping windows of
``WINDOW`` characters cover every text from end to end; each window is decoded by Viterbi, spans cut by its edge are left to the
window beside it or, if they reach beyond what the two share, read again in a wider window, and of all windows' spans of a document the set
without overlaps that has the greatest sum of marginal probability times length is kept.  Base spans always stay and displace others.  A found span must then hold what its kind needs (card: 16 to 19 digits
passing Luhn; address: four parts of at most 255; phone: 7 to 15 digits; e-mail: a name, a host and a dot, spelled out or not).

The model is trained once in each driver process and sent to the tasks (some 50 KB).

Edge cases: null and empty texts have no spans; repeated rows are judged alike; spans of one kind and start never
tie; very long texts are read whole, window by window; an empty table gives an empty result; other
columns pass through or are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm import arrowtext
from wavelake.llm.storage import fresh

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and how many of them it shares with the next.
WINDOW, STRIDE = 1024, 48
HIDDEN = 24
#: How many of the batches that fit the processor's cache when they are read are decoded together: steps of Viterbi are short.
DECODED = 8
#: Least mean of the marginal probabilities of a span's tags.
SURE = 0.6

#: No usual form is without one of these.
_gate = re.compile("[0-9@]")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: After a plain "at" a full stop with a space ends a sentence.
_SIGN, _WORD = r"\s*(?:@|[\[({<]\s*(?:at|@)\s*[\])}>])\s*", r"\s+at\s+"
_DOT = r"(?:{}|\s*[\[({{<]\s*(?:dot|\.)\s*[\])}}>]\s*|\s+dot\s+)"
_HOSTS = [at + rf"[A-Za-z0-9-]+(?:{_DOT.format(dot)}[A-Za-z0-9-]+)+" for at, dot in ((_SIGN, r"\s*\.\s*"), (_WORD, r"\."))]
_SPELLED = re.compile(rf"[A-Za-z0-9._%+-]+(?:{'|'.join(_HOSTS)})", re.ASCII | re.IGNORECASE)

#: Two words with nothing of an address between them.
_TORN = re.compile(r"\s(?!(?:at|dot)\s)[A-Za-z0-9_%+-]+\s+(?!(?:at|dot)\s)[A-Za-z0-9_%+-]+\s", re.ASCII | re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the usual forms, by kind and start."""
    if not _gate.search(text):
        return []
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        # before an "@" the longest run of characters of a name, after what was found before
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            free = host.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        found = _digits(m[0])
        if 16 <= len(found) <= 19 and luhn(found):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a span has what its kind needs."""
    if kind == "email":
        return _SPELLED.fullmatch(text) is not None
    found = _digits(text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(found) <= 19 and luhn(found)
    return 7 <= len(found) <= 15 and not re.search("[A-Za-z]", text)


# --- generated windows with labelled spans ---


class _Writer:
    """Windows of invented text around personal data and what looks like it."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.pick = lambda *options: self.rng.choice(options)

    def number(self, n: int, first: str = "0123456789") -> str:
        return "".join([self.pick(*first), *(self.pick(*"0123456789") for _ in range(n - 1))]) if n else ""

    def word(self) -> str:
        letters = self.pick("etaoinshrdlucmfwyp", "etaoinshrdlucmfwyp", "aeiouéèçãñüöß" + "bcdlmnprst", "абвгдеиклмнопрст", "的一是不了人我在有他")
        w = "".join(self.pick(*letters) for _ in range(self.rng.randrange(1, 9)))
        return w if self.rng.random() < 0.8 else w.capitalize() if self.rng.random() < 0.7 else w.upper()

    def name(self) -> str:
        return "".join(self.pick(*"etaoinshrdlucmfw") for _ in range(self.rng.randrange(2, 9)))

    def email(self) -> str:
        user = self.name() + self.pick("", "", self.number(2), "." + self.name(), "_" + self.name(), "-" + self.name())
        hosts = [self.name() + self.pick("", "", self.number(1), "-" + self.name()) for _ in range(self.pick(1, 1, 2))]
        end = self.pick("com", "org", "net", "edu", "de", "fr", "io", "example")
        at = self.pick("@", "@", " at ", " (at) ", "(at)", "[at]", " [at] ", " @ ", "{at}", " AT ")
        dot = self.pick(".", ".", " . ") if at in ("@", " @ ") and self.rng.random() < 0.7 else self.pick(" dot ", ".", " (dot) ", "(dot)", "[dot]", " [dot] ", " DOT ")
        return user + at + dot.join([*hosts, end])

    def ip(self) -> str:
        sep = self.pick(".", ".", "[.]", " . ", " dot ", "(.)", "[dot]")
        return sep.join(str(self.rng.randrange(0, 256)) for _ in range(4))

    def card(self) -> str:
        body = self.number(15, "3456")
        # the digits' check follows the model
        digits = body + self.number(1)
        sep = self.pick("", "", " ", "-", ".", "  ", "/", "_", " - ")
        return sep.join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.number(3, "23456789"), self.number(3, "23456789"), self.number(4)
        area = self.number(self.pick(2, 3), "123456789")
        return self.pick(
            f"+{self.number(self.pick(1, 2), '123456789')} ({a}) {b}-{c}", f"+{self.number(2, '123456789')} {area} {self.number(self.pick(5, 6, 7))}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{area} {self.number(self.pick(5, 6, 7))}",
            f"0{area}/{self.number(self.pick(5, 6, 7))}", f"(0{area}) {self.number(self.pick(5, 6, 7))}", f"00{self.number(2, '123456789')} {area} {self.number(self.pick(6, 7))}", f"1-{a}-{b}-{c}", f"+{self.number(2, '123456789')}-{a}-{b}-{c}",
        )

    def decoy(self) -> str:
        n = self.rng.randrange
        day, month, year = n(1, 29), n(1, 13), n(1900, 2030)
        hexes = "".join(self.pick(*"0123456789abcdef") for _ in range(self.pick(8, 16, 32, 40)))
        return self.pick(
            f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{n(24)}:{n(60):02d}:{n(60):02d}", f"v{n(9)}.{n(20)}.{n(20)}", f"{n(9)}.{n(20)}", f"${n(1000)},{self.number(3)}.{self.number(2)}",
            str(year), self.number(self.pick(1, 2, 3, 4, 5, 6)), self.number(self.pick(7, 8, 9, 10, 11, 12, 13)), hexes, f'token = "{hexes}"', "-".join(hexes[k : k + 4] for k in range(0, 16, 4)), f"{self.number(3)}-{self.number(1)}-{self.number(2)}-{self.number(6)}-{self.number(1)}", f"{n(100)}-{n(100)}",
            f"@{self.name()}", f"{self.name()}@{self.name()}", f"{self.name()} dot {self.name()}", f"look at the dot {self.name()}", f"meet at {self.name()}", f"{self.number(2)}%", f"{n(20)} + {n(20)} = {n(40)}", f"https://{self.name()}.com/{self.name()}/{self.number(4)}", f"{self.name()}{self.number(3)}",
            f"{self.name()}.{self.name()}", f"{self.number(3)} {self.number(3)}", f"{self.number(1)}.{self.number(3)}.{self.number(3)}", f"{self.number(1)},{self.number(3)},{self.number(3)}", f"({year})", f"[{n(99)}]", f"p. {n(999)}", f"#{self.number(4)}",
            f"{n(300)}.{n(300)}.{n(300)}", f"{self.number(2)} {self.number(2)} {self.number(2)} {self.number(2)}", f"{self.name()} at {self.number(2)}", f"{self.number(4)}x{self.number(4)}", f"{self.number(3)}.{self.number(10)}", f"{year}/{self.number(5)}",
        )

    def window(self, size: int = WINDOW) -> tuple[str, list[tuple[int, int, int]]]:
        """A window of text and its spans as (kind number, start, end), those cut by an edge included."""
        text, spans = "", []
        lead = int(self.rng.randrange(0, size))
        while len(text) < lead + size:
            p = self.rng.random()
            if p < 0.72:
                text += self.word()
            elif p < 0.86:
                kind = int(self.rng.randrange(len(KINDS)))
                found = getattr(self, KINDS[kind])()
                text += self.pick("", "", "", "(", '"', "<", "tel: ", "mail ", ": ")
                spans.append((kind, len(text), len(text) + len(found)))
                text += found
            else:
                text += self.decoy()
            text += self.pick(" ", " ", " ", " ", ", ", ". ", "\n", "!! ", " | ", "*** ", ") ", "; ")
        cut = [(kind, max(0, a - lead), min(size, b - lead)) for kind, a, b in spans if b > lead and a < lead + size]
        return text[lead : lead + size], cut


# --- the model ---

_OTHER, _LETTER_CLASS, _PAD = 128, 129, 130
_CLASSES = 131
TAGS = 1 + 2 * len(KINDS)


def _allowed() -> np.ndarray:
    """Whether a tag may follow another: an inside only the begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_ALLOWED = _allowed()


@functools.cache
def _class_of() -> np.ndarray:
    """The class of every code point: digits are one, letters count without case, beyond ASCII only whether they are letters."""
    out = np.array([_LETTER_CLASS if chr(c).isalpha() else _OTHER for c in range(0x110000)], np.uint8)
    out[:128] = np.arange(128)
    out[48:58] = 48
    out[65:91] += 32
    return out


def _classes(text: str) -> np.ndarray:
    return _class_of()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def _columns(rows: list[np.ndarray], window: int) -> np.ndarray:
    """(steps, windows) classes, padded to ``window`` steps."""
    out = np.full((len(rows), window), _PAD, np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out.T


def encode(texts: list[str], window: int = WINDOW) -> np.ndarray:
    """(steps, windows) classes of characters."""
    return _columns([_classes(t) for t in texts], window)


def tags_of(spans: list[tuple[int, int, int]], window: int = WINDOW) -> np.ndarray:
    y = np.zeros(window, np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


class Tagger:
    """Bidirectional LSTM over character classes, linear scores of tags, CRF transitions.

    Both directions run in one loop, as two matrices of a stack.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        w = {
            "x": (rng.standard_normal((2, _CLASSES, 4 * HIDDEN)) * 0.3).astype(np.float32),
            "h": (rng.standard_normal((2, HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32),
            "b": np.zeros((2, 1, 4 * HIDDEN), np.float32),
            "out": (rng.standard_normal((2 * HIDDEN, TAGS)) * 0.1).astype(np.float32),
            "bias": np.zeros(TAGS, np.float32),
            "step": np.zeros((TAGS, TAGS), np.float32),
        }
        w["b"][:, :, HIDDEN : 2 * HIDDEN] = 1.0
        return cls(w)

    def scores(self, x: np.ndarray, keep: bool = False):
        """(steps, windows, tags); the states and what the way back needs."""
        steps, n = x.shape
        table, wh, size = self.w["x"] + self.w["b"], self.w["h"], HIDDEN
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        states, tape = np.empty((steps, n, 2 * size), np.float32), []
        for k in range(steps):
            a = h @ wh
            a[0] += table[0].take(x[k], 0)
            a[1] += table[1].take(x[-1 - k], 0)
            s = 1 / (1 + np.exp(-a[..., : 3 * size]))
            g = np.tanh(a[..., 3 * size :])
            i, f, o = s[..., :size], s[..., size : 2 * size], s[..., 2 * size :]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((h, c, i, f, o, g, tc))
            h, c = o * tc, new
            states[k, :, :size], states[-1 - k, :, size:] = h
        return states @ self.w["out"] + self.w["bias"], states, tape

    def _chain(self, e: np.ndarray, sizes: np.ndarray | None = None):
        """Scaled forward and backward sums, the scales, the scaled scores, the transitions, and each window's log sum."""
        through = np.exp(self.w["step"].astype(float)) * _ALLOWED
        top = e.max(axis=2, keepdims=True)
        own = np.exp((e - top).astype(float))
        a, b, scale = np.empty_like(own), np.ones_like(own), np.empty((*own.shape[:2], 1))
        for k in range(len(e)):
            now = own[k] if k == 0 else (a[k - 1] @ through) * own[k]
            scale[k] = now.sum(axis=1, keepdims=True)
            a[k] = now / scale[k]
        for k in range(len(e) - 2, -1, -1):
            b[k] = (own[k + 1] * b[k + 1] / scale[k + 1]) @ through.T
            if sizes is not None:
                b[k, sizes <= k + 1] = 1
        return a, b, scale, own, through, (np.log(scale) + top).sum(axis=(0, 2))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the windows and its gradients; ``y``: (steps, windows) tags."""
        e, states, tape = self.scores(x, keep=True)
        n, size = x.shape[1], HIDDEN
        a, b, scale, own, through, total = self._chain(e)
        told = np.take_along_axis(e, y[..., None], 2)[..., 0].sum(axis=0) + self.w["step"][y[:-1], y[1:]].sum(axis=0)
        de = a * b
        np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - 1, 2)
        de = (de / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        moves = through * (a[:-1].reshape(-1, TAGS).T @ (own[1:] * b[1:] / scale[1:]).reshape(-1, TAGS))
        np.subtract.at(moves, (y[:-1].ravel(), y[1:].ravel()), 1)
        grads["step"] = (moves / n).astype(np.float32)
        grads["out"] = states.reshape(-1, 2 * size).T @ de.reshape(-1, TAGS)
        grads["bias"] = de.sum(axis=(0, 1))
        dstates = de @ self.w["out"].T
        dh, dc = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        dpre = np.empty((len(x), 2, n, 4 * size), np.float32)
        wh = self.w["h"].transpose(0, 2, 1)
        for k in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tc = tape[k]
            dh[0] += dstates[k, :, :size]
            dh[1] += dstates[-1 - k, :, size:]
            dnew = dc + dh * o * (1 - tc * tc)
            d = dpre[k]
            d[..., :size], d[..., size : 2 * size] = dnew * g * i * (1 - i), dnew * c * f * (1 - f)
            d[..., 2 * size : 3 * size], d[..., 3 * size :] = dh * tc * o * (1 - o), dnew * i * (1 - g * g)
            grads["h"] += h.transpose(0, 2, 1) @ d
            dh, dc = d @ wh, dnew * f
        for side, seen in enumerate((x, x[::-1])):
            order = np.argsort(seen.ravel(), kind="stable")
            classes, at = np.unique(seen.ravel()[order], return_index=True)
            grads["x"][side, classes] = np.add.reduceat(dpre[:, side].reshape(-1, 4 * size)[order], at, axis=0)
        grads["b"] = dpre.sum(axis=(0, 2))[:, None, :]
        return float((total - told).mean()), grads

    def read(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``scores`` of the first ``sizes`` (falling) steps of each window, without what training needs; zeros beyond.

        The way back passes padding first and starts anew at the end of each window.  Sigmoids are halves of tangents, whose
        factors the weights take; each gate lies in one piece.
        """
        (steps, n), size = x.shape, HIDDEN
        half = np.repeat([0.5, 0.5, 0.5, 1.0], size)
        apart = lambda v: np.ascontiguousarray(v.reshape(2, -1, 4, size).transpose(2, 0, 1, 3), np.float32)
        table, wh = apart((self.w["x"] + self.w["b"]) * half).reshape(4, 2 * _CLASSES, size), apart(self.w["h"] * half / 2)
        out = (self.w["out"] / 2).reshape(2, size, TAGS).astype(np.float32)
        at = np.stack([x, x[::-1] + _CLASSES], axis=1)
        # how many windows reach each step, the one after the last included
        active = np.searchsorted(-sizes, -np.arange(steps + 1)).tolist()
        there, back = (np.zeros((steps, n, TAGS), np.float32) for _ in range(2))
        h, c, y = (np.zeros((2, n, size), np.float32) for _ in range(3))
        a, own = (np.empty((4, 2, n, size), np.float32) for _ in range(2))
        for k in range(steps):
            m, last = active[k], steps - 1 - k
            if active[last] > active[last + 1]:
                h[1, active[last + 1] : active[last]] = c[1, active[last + 1] : active[last]] = 0
            np.matmul(h, wh, out=a)
            a += table.take(at[k], 1, out=own, mode="clip")
            np.tanh(a, out=a)
            a[:3] += 1
            c *= a[1]
            c += np.multiply(a[0], a[3], out=y)
            c *= 0.5
            np.multiply(a[2], np.tanh(c, out=y), out=h)
            np.matmul(h[0, :m], out[0], out=there[k, :m])
            np.matmul(h[1, : active[last]], out[1], out=back[last, : active[last]])
        there += back
        there.reshape(steps, -1)[:] += np.tile(self.w["bias"].astype(np.float32), n)
        return there

    def paths(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(windows, steps): the best tags of each window's first ``sizes`` (falling) steps by Viterbi, zeros beyond."""
        return self._follow(e.transpose(0, 2, 1).astype(np.float32, order="C"), sizes)

    def _follow(self, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``paths`` of scores as (steps, tags, windows), which become those of the best ways to each tag."""
        steps, _, n = best.shape
        step = np.where(_ALLOWED, self.w["step"], -1e9).astype(np.float32)
        # outside and begins follow any tag, an inside two
        free = np.concatenate([step[:, :1], step[:, 1::2]], axis=1)[:, :, None]
        begun, on = np.diag(step[1::2, 2::2])[:, None], np.diag(step[2::2, 2::2])[:, None]
        active = np.searchsorted(-sizes, -np.arange(steps))
        #: Whether outside comes best from outside.
        stays = np.zeros((steps + 1, n), bool)
        for k in range(1, steps):
            m = active[k]
            before, now = best[k - 1, :, :m], best[k, :, :m]
            through = before[:, None] + free
            top = through.max(axis=0)
            stays[k, :m] = through[0, 0] == top[0]
            now[0] += top[0]
            now[1::2] += top[1:]
            now[2::2] += np.maximum(before[1::2] + begun, before[2::2] + on)
        # after the end of a window comes a tag that costs nothing
        onto = np.vstack([step.T, np.zeros((1, TAGS), np.float32)])
        tags, follows = np.zeros((steps, n), np.int8), np.full(n, TAGS)
        for k in range(steps - 1, -1, -1):
            m = active[k]
            turns = np.flatnonzero((follows[:m] != 0) | ~stays[k + 1, :m])
            if len(turns):
                follows[turns] = tags[k, turns] = (best[k][:, turns].T + onto[follows[turns]]).argmax(axis=1)
        return tags.T

    def marginals(self, e: np.ndarray, tags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(windows, steps): the probability of each tag of ``tags`` in a window's first ``sizes`` steps."""
        a, b = self._chain(e, sizes)[:2]
        return np.take_along_axis(a * b, tags.T[..., None].astype(np.int64), 2)[..., 0].T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, steps): the best tags, and the marginal probability of each."""
        sizes = np.full(x.shape[1], len(x))
        e = self.read(x, sizes)
        tags = self.paths(e, sizes)
        return tags, self.marginals(e, tags, sizes)


@functools.cache
def trained(windows: int = 3000, epochs: int = 8, batch: int = 32, window: int = 72, rate: float = 0.1, seed: int = 11) -> Tagger:
    """A tagger fitted by Adam to generated windows, the same on every run."""
    rng, writer = np.random.default_rng(seed), _Writer(seed)
    made = [writer.window(window) for _ in range(windows)]
    x, y = encode([t for t, _ in made], window), np.stack([tags_of(s, window) for _, s in made], axis=1)
    model = Tagger.fresh(rng)
    mean, square = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    done, total = 0, epochs * (windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for k in range(0, windows - batch + 1, batch):
            some = order[k : k + batch]
            _, grads = model.gradients(x[:, some], y[:, some])
            done += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1.02 - done / total) * min(1.0, 5.0 / max(norm, 1e-9))
            for name, g in grads.items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g * g
                model.w[name] -= now * (mean[name] / (1 - 0.9**done)) / (np.sqrt(square[name] / (1 - 0.99**done)) + 1e-6)
    return model


# --- whole texts ---


def window_starts(text: str) -> list[int]:
    """Starts of windows that cover the text; neighbours share ``STRIDE`` characters."""
    return list(range(0, max(len(text) - STRIDE, 1), WINDOW - STRIDE)) if text else []


def _runs(tags: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
    """(window, start, end, kind, whether it begins here) of each run of tags of a span."""
    flat = np.pad(tags, ((0, 0), (0, 1))).ravel()
    width = tags.shape[1] + 1
    inside, first = flat > 0, (flat & 1).astype(bool)
    goes_on = inside & ~first
    first[::width] |= goes_on[::width]
    # an inside follows its own kind, so runs end in the order in which they begin
    begins, ends = np.flatnonzero(first), np.flatnonzero(inside[:-1] & ~goes_on[1:]) + 1
    rows, kinds = begins // width, (flat[begins] - 1) // 2
    return zip(rows.tolist(), (begins % width).tolist(), (ends - rows * width).tolist(), kinds.tolist(), (flat[begins] % 2 == 1).tolist(), strict=True)


def _may_grow(kind: str, part: str) -> bool:
    """Whether a span that holds ``part`` can be plausible."""
    return not _TORN.search(part) if kind == "email" else len(_digits(part)) <= 19


def _read(texts: list[str], windows: list[tuple[int, int, int]], model: Tagger, at_once: int, found: list[list]) -> list[tuple[int, int, int]]:
    """Add the plausible spans (weight, start, end, kind) of windows (text, start, end) to ``found``; the wider windows that cut spans need."""
    windows = sorted(windows, key=lambda w: (w[1] - w[2], w))
    classes = {d: _classes(texts[d]) for d in {w[0] for w in windows}}
    wider: list[tuple[int, int, int]] = []
    held: list[tuple] = []
    k = 0
    while k < len(windows):
        fit = lambda size: max(1, at_once * WINDOW // max(size, WINDOW))
        longest = windows[k][2] - windows[k][1]
        some = windows[k : k + fit(longest) * DECODED]
        k += len(some)
        sizes = np.array([b - a for _, a, b in some])
        best, scores = np.zeros((longest, TAGS, len(some)), np.float32), []
        while (r := len(scores)) < len(some):
            few = fit(sizes[r])
            e = model.read(_columns([classes[d][a:b] for d, a, b in some[r : r + few]], sizes[r]), sizes[r : r + few])
            best[: sizes[r], :, r : r + few] = e.transpose(0, 2, 1)
            scores.extend(e.transpose(1, 0, 2))
        tags = model._follow(best, sizes)
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for r, a, b, kind, begins in _runs(tags):
            d, start, end = some[r]
            left, right = a == 0 and start > 0, start + b == end and end < len(texts[d])
            if left or right:
                if b - a >= STRIDE and _may_grow(KINDS[kind], texts[d][start + a : start + b]):
                    wider.append((d, max(0, start + a - (end - start)), min(len(texts[d]), start + b + end - start)))
            elif begins and plausible(KINDS[kind], texts[d][start + a : start + b]):
                spans.setdefault(r, []).append((a, b, kind))
        held += [(some[r], scores[r][: sizes[r]].copy(), tags[r, : sizes[r]].copy(), own) for r, own in spans.items()]
        # marginals of windows with such spans, some at a time; few wait for the next batches
        while held and (k == len(windows) or sum(len(e) for _, e, _, _ in held) >= at_once * WINDOW):
            held.sort(key=lambda w: -len(w[1]))
            part = held[: max(1, at_once * WINDOW // max(len(held[0][1]), WINDOW) // 4)]
            held = held[len(part) :]
            sizes = np.array([len(e) for _, e, _, _ in part])
            e, tags = np.zeros((sizes[0], len(part), TAGS), np.float32), np.zeros((len(part), sizes[0]), np.int8)
            for r, (_, one, path, _) in enumerate(part):
                e[: sizes[r], r], tags[r, : sizes[r]] = one, path
            for sure, ((d, start, _), _, _, own) in zip(model.marginals(e, tags, sizes), part, strict=True):
                for a, b, kind in own:
                    if (p := float(sure[a:b].mean())) >= SURE:
                        found[d].append((p * (b - a), start + a, start + b, kind))
    out: list[tuple[int, int, int]] = []
    for d, a, b in sorted(wider):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((d, a, b))
    return out


def _apart(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans without overlaps of greatest total weight; of equal ones the first by end, start and kind."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[3], -s[0]))
    ends = [s[2] for s in found]
    best, took = [0.0], []
    for k, (w, a, _, _) in enumerate(found):
        before = bisect.bisect_right(ends, a, 0, k)
        took.append(before if best[before] + w > best[k] else None)
        best.append(max(best[k], best[before] + w))
    out, k = [], len(found)
    while k:
        if took[k - 1] is None:
            k -= 1
        else:
            out.append(found[k - 1][1:])
            k = took[k - 1]
    return out


def spans_of(texts: list[str], model: Tagger, at_once: int = 384) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, whether the patterns found it) of each text, by kind and start."""
    found: list[list] = [[] for _ in texts]
    windows = [(d, s, min(s + WINDOW, len(t))) for d, t in enumerate(texts) for s in window_starts(t)]
    while windows:
        windows = _read(texts, windows, model, at_once, found)
    out = []
    for text, spans in zip(texts, found, strict=True):
        base = base_spans(text)
        edges = sorted((a, b) for _, a, b in base)
        first = [a for a, _ in edges]
        # base spans of two kinds may overlap, so the furthest end so far counts
        reach = list(np.maximum.accumulate([b for _, b in edges])) if edges else []

        def is_free(a: int, b: int, first=first, reach=reach) -> bool:
            k = bisect.bisect_left(first, b)
            return not k or reach[k - 1] <= a

        own = [(KINDS[kind], a, b, False) for a, b, kind in _apart([s for s in spans if is_free(s[1], s[2])])]
        out.append(sorted([(*s, True) for s in base] + own, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean>>"


def find_private(docs: DataFrame, text: str = "text", model: Tagger | None = None) -> DataFrame:
    """``docs`` with a last column ``_spans`` (with more underscores if ``docs`` has that name): ``array<struct<kind, start, stop, base>>``.

    Positions count code points, ``stop`` excluded; ``base`` marks what the patterns found.
    """
    name = fresh(docs, "_spans")
    held = docs.sparkSession.sparkContext.broadcast((model or trained()).w)

    @F.arrow_udf(SPANS)
    def private(column: pa.Array) -> pa.Array:
        tagger = Tagger(held.value)
        out: list[list] = []
        for part in arrowtext.slices(pa.RecordBatch.from_arrays([column.fill_null("")], ["text"]), size=1 << 24):
            for spans in spans_of(part.column("text").to_pylist(), tagger):
                out.append([{"kind": kind, "start": a, "stop": b, "base": base} for kind, a, b, base in spans])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])))

    return docs.select("*", private(F.col(f"`{text}`")).alias(name))


def mask_private(docs: DataFrame, text: str = "text", model: Tagger | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; of spans that overlap, the one that starts first and reaches furthest."""
    found = find_private(docs, text, model)
    spans, t = F.col(f"`{found.columns[-1]}`"), F.col(f"`{text}`")
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), (-s["stop"]).alias("at"))
    )
    masked = F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.length(t))))
    return found.select(*[(F.when(F.size(spans) > 0, masked).otherwise(t).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])
