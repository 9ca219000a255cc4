"""Personal data by a semi-Markov conditional random field over whole spans.

Fixed patterns give the base spans, which always stay. A semi-Markov CRF then adds what they miss (phone numbers
without a plus, spelled-out addresses, credentials): features of a whole candidate span score it for each type,
and dynamic programming over entities chooses boundaries and types together. An entity has a bounded number of words,
each of any length; an unbroken run of key characters is also one candidate as a whole. A candidate must
hold a digit, an at sign or a spelled-out dot and be of a form that stops at certain characters. So every candidate
lies whole in one zone: a longest stretch of text in which such forms can lie, with whole words at its ends. Words
outside all zones can't be in any entity, and decoding zone by zone, each seen with what stands around it, gives the
optimum of the whole text. The model is trained at first use, by exact likelihood gradients on generated text, and
sent to the workers with the function.

Edge cases: null and empty texts have no spans; offsets are code points, ends exclusive; texts of any length are
searched whole in time linear in their length, lines of numbers included; of overlapping base spans all stay, and the
method adds none that overlaps one; equal rows get equal spans; an empty table gives an empty result; other columns
pass through, whatever they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_CACHE_BYTES, WordCache, table

#: Order of kinds in results; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
ENTITIES = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+=-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    found["email"] = _emails(text)
    if not _DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# -- zones, tokens and candidates --

#: The most tokens in an entity that isn't a whole run of key characters, and the longest word that an address can
#: have (RFC 5321: local parts have 64 characters, labels 63).
LONGEST, WORD = 26, 64
#: Characters before a candidate that its features see; of those after it they see one.
BEFORE = 24
#: No candidate is shorter.
SHORTEST = 7
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z])")
_TOKEN = re.compile(r"[^\W_]+|.", re.S)
_LONG_WORD = re.compile(rf"[^\W_]{{{WORD + 1}}}")
_SECRET_RUN = re.compile(r"[A-Za-z0-9_/+=-]+")
_KEY_RUN = re.compile(r"[A-Za-z0-9_/+-]+")
#: What candidates consist of: runs of address or key characters; at most two spaces and a bracket link such runs if
#: one of them ends or begins with a spelled-out sign; blanks and brackets link runs that end and begin with digits.
_RUN = re.compile(r"[A-Za-z0-9._%+@/=-]+")
_LINK = re.compile(r" ?[\[\](){}]? ?")
_SIGN_BEFORE, _SIGN_AFTER = re.compile(r"(?:at|AT|dot|DOT|@)$"), re.compile(r"at|AT|dot|DOT|@")
_NUMBER_LINK = re.compile(r"[ ()]+")
_DIGIT_ENDS, _DIGIT_STARTS = re.compile(r"[0-9.-]$"), re.compile(r"[0-9.-]")


def zones(text: str) -> list[tuple[int, int]]:
    """Longest stretches in which a candidate can lie, with whole words at their ends, that hold a trigger."""
    out: list[tuple[int, int]] = []
    triggers = [m.start() for m in _TRIGGER.finditer(text)]
    t = 0
    a = b = -1  # the stretch that is being made

    def settle() -> None:
        nonlocal t
        if a < 0:
            return
        lo, hi = a, b
        if lo and text[lo - 1] in "(":  # numbers may begin with it
            lo -= 1
        while lo and text[lo].isalnum() and text[lo - 1].isalnum():
            lo -= 1
        while hi < len(text) and text[hi].isalnum() and text[hi - 1].isalnum():
            hi += 1
        while t < len(triggers) and triggers[t] < lo:
            t += 1
        if hi - lo >= SHORTEST and t < len(triggers) and triggers[t] < hi:
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))

    if not triggers:
        return out
    for m in _RUN.finditer(text):
        s, e = m.span()
        if a >= 0 and s - b <= 3 and _LINK.fullmatch(text, b, s) and (_SIGN_AFTER.match(text, s) or _SIGN_BEFORE.search(text, max(a, b - 3), b)):
            b = e
        elif a >= 0 and _NUMBER_LINK.fullmatch(text, b, s) and _DIGIT_STARTS.match(text, s) and _DIGIT_ENDS.search(text, b - 1, b):
            b = e
        else:
            settle()
            a, b = s, e
    settle()
    return out


_SECRET_KEY = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|credential)s?\W{0,4}$", re.I)
_SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({]? ?(?:at|AT|@) ?[\])}]? ?[A-Za-z0-9-]+(?:(?: ?[\[({]? ?(?:dot|DOT) ?[\])}]? ?|\.)[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}"),
    re.compile(r"\+?[0-9][ ().0-9-]+[0-9]"),
    re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    re.compile(r"[0-9a-f]{16,}"),
    re.compile(r"[A-Za-z0-9_/+=-]{16,}"),
)
FEATURES, KEY_CHARS = 24, 256


def _features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in s)
    n = len(digits)
    before = text[max(0, a - BEFORE) : a]
    # the first two are of addresses
    whole = [1.0 if p.fullmatch(s) else 0.0 for p in _SHAPES] if not _LONG_WORD.search(s) else [0.0, 0.0, *(1.0 if p.fullmatch(s) else 0.0 for p in _SHAPES[2:])]
    quad = whole[2] and all(int(p) <= 255 for p in s.split("."))
    return [
        1.0,
        *whole,
        1.0 if quad else 0.0,
        1.0 if 16 <= n <= 19 and not letters and luhn(digits) else 0.0,
        1.0 if 16 <= n <= 19 and not letters else 0.0,
        1.0 if 8 <= n <= 15 and not letters else 0.0,
        1.0 if n in (10, 11) and not letters else 0.0,
        1.0 if n < 7 else 0.0,
        1.0 if s[0] == "+" else 0.0,
        1.0 if letters and n >= 4 else 0.0,
        1.0 if _SECRET_KEY.search(before) else 0.0,
        1.0 if " " in s else 0.0,
        1.0 if s[0] == "(" and ")" not in s or s[-1] == "(" else 0.0,
        1.0 if before[-1:] in "+@._%-/" and before else 0.0,
        1.0 if text[b : b + 1] in "@%-/+_" and text[b : b + 1] else 0.0,
        # longer keys than the training's count as its longest
        min(len(s), KEY_CHARS) / 32.0,
    ]


_NUMBER_CHARS = re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]")


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token ranges that may be entities: at word boundaries, of one of the general forms, of up to LONGEST tokens or
    whole runs of key characters. Words longer than WORD are in keys only."""
    out = []
    n = len(tokens)
    starts = [k for k, (a, b) in enumerate(tokens) if (text[a].isalnum() or text[a] in "+(") and (a == 0 or not text[a - 1].isalnum() or not text[a].isalnum())]
    ends = [k + 1 for k, (a, b) in enumerate(tokens) if text[b - 1].isalnum() and (b == len(text) or not text[b].isalnum())]
    long = [k for k, (a, b) in enumerate(tokens) if b - a > WORD]
    triggers = [m.start() for m in _TRIGGER.finditer(text, tokens[0][0], tokens[-1][1])] if tokens else []
    run = number = 0  # ends of the run of key characters, and of the number, that hold the start
    j, near = 0, 0
    for s in starts:
        a = tokens[s][0]
        if a >= run:
            run = m.end() if (m := _SECRET_RUN.match(text, a)) else a
        number = m.end() if (m := _NUMBER_CHARS.match(text, a)) else a
        while near < len(triggers) and triggers[near] < a:
            near += 1
        if near == len(triggers):
            break
        k = bisect_right(long, s - 1)
        word = long[k] if k < len(long) else n
        while j < len(ends) and ends[j] <= s:
            j += 1
        for i in range(j, len(ends)):
            e = ends[i]
            b = tokens[e - 1][1]
            if e - s > LONGEST or e > word and b > run:
                break
            if b - a < SHORTEST or triggers[near] >= b:
                continue
            if b <= run and b - a >= 12:
                out.append((s, e))
                continue
            x = text[a:b] if e <= word else ""
            if b <= number and _NUMBER_CHARS.fullmatch(x) or _SHAPES[0].fullmatch(x) or _SHAPES[1].fullmatch(x):
                out.append((s, e))
    at = [tokens[s][0] for s in starts]
    to = [tokens[e - 1][1] for e in ends]
    for m in _KEY_RUN.finditer(text, tokens[0][0], tokens[-1][1]) if n > LONGEST else ():
        i, j = bisect_left(at, m.start()), bisect_right(to, m.end()) - 1
        if i < len(starts) and j >= 0 and ends[j] - starts[i] > LONGEST and _TRIGGER.search(text, at[i], to[j]):
            out.append((starts[i], ends[j]))
    return out


class Lattice:
    """The tokens, candidate segments and their features of a stretch of text (all of it, if no stretch is given)."""

    def __init__(self, text: str, lo: int = 0, hi: int | None = None):
        hi = len(text) if hi is None else hi
        self.followed = hi < len(text)
        self.tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        self.segments = candidates(text, self.tokens)
        self.x = np.array([_features(text, self.tokens[s][0], self.tokens[e - 1][1]) for s, e in self.segments]).reshape(-1, FEATURES)


class SemiCRF:
    """Labels: 0 outside (one token each), 1.. the kinds. weights: kinds x features; moves: label x label."""

    def __init__(self):
        k = len(KINDS)
        self.weights, self.moves = np.zeros((k, FEATURES)), np.zeros((k + 1, k + 1))

    def decode(self, lat: Lattice) -> list[tuple[int, int, int]]:
        """(first token, end token, kind) of the best segmentation's entities."""
        if not lat.segments:
            return []
        n, k = len(lat.tokens), len(KINDS) + 1
        score = lat.x @ self.weights.T
        ending: dict[int, list[int]] = {}
        for i, (_, e) in enumerate(lat.segments):
            ending.setdefault(e, []).append(i)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0.0
        back: list[list[tuple[int, int, int] | None]] = [[None] * k for _ in range(n + 1)]
        for t in range(1, n + 1):
            to = best[t - 1] + self.moves[:, 0]
            y = int(to.argmax())
            best[t, 0], back[t][0] = to[y], (t - 1, y, -1)
            for i in ending.get(t, ()):
                s = lat.segments[i][0]
                to = best[s][:, None] + self.moves[:, 1:]
                prev = to.argmax(axis=0)
                value = to[prev, range(k - 1)] + score[i]
                for z in np.flatnonzero(value > best[t, 1:]):
                    best[t, z + 1], back[t][z + 1] = value[z], (s, int(prev[z]), i)
        # what follows a stretch is outside
        out, t, y = [], n, int((best[n] + self.moves[:, 0] * lat.followed).argmax())
        while t > 0:
            s, before, i = back[t][y]
            if i >= 0:
                out.append((s, t, y - 1))
            t, y = s, before
        return out[::-1]

    def gradient(self, lat: Lattice, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold entities (first token, end token, kind), and its gradients."""
        n, k = len(lat.tokens), len(KINDS) + 1
        score = lat.x @ self.weights.T
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for i, (s, e) in enumerate(lat.segments):
            ending.setdefault(e, []).append(i)
            starting.setdefault(s, []).append(i)
        add = np.logaddexp
        alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        for t in range(1, n + 1):
            alpha[t, 0] = add.reduce(alpha[t - 1] + self.moves[:, 0])
            for i in ending.get(t, ()):
                alpha[t, 1:] = add(alpha[t, 1:], add.reduce(alpha[lat.segments[i][0]][:, None] + self.moves[:, 1:], axis=0) + score[i])
        beta[n] = 0.0
        for t in range(n - 1, -1, -1):
            beta[t] = self.moves[:, 0] + beta[t + 1, 0]
            for i in starting.get(t, ()):
                beta[t] = add(beta[t], add.reduce(self.moves[:, 1:] + (score[i] + beta[lat.segments[i][1], 1:])[None, :], axis=1))
        z = add.reduce(alpha[n])
        dw, dm, ll = np.zeros_like(self.weights), np.zeros_like(self.moves), 0.0
        for t in range(n):
            dm[:, 0] -= np.exp(alpha[t] + self.moves[:, 0] + beta[t + 1, 0] - z)
        for i, (s, e) in enumerate(lat.segments):
            p = np.exp(alpha[s][:, None] + self.moves[:, 1:] + (score[i] + beta[e, 1:])[None, :] - z)
            dm[:, 1:] -= p
            dw -= np.outer(p.sum(axis=0), lat.x[i])
        where = {x: i for i, x in enumerate(lat.segments)}
        t, y = 0, 0
        for s, e, kind in [*gold, (n, n, -1)]:
            for _ in range(t, s):
                dm[y, 0] += 1
                ll += self.moves[y, 0]
                y = 0
            if kind >= 0:
                i = where[s, e]
                dm[y, kind + 1] += 1
                dw[kind] += lat.x[i]
                ll += self.moves[y, kind + 1] + score[i, kind]
                t, y = e, kind + 1
        return ll - z, dw, dm


# -- generated training text --

_WORD_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _generate(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of invented words with entities and look-alikes: (text, [(start, end, kind)])."""
    pick = lambda *x: x[rng.integers(len(x))]
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(pick(*of) for _ in range(n))
    num = lambda n: letters(n, "0123456789")
    word = lambda: letters(int(rng.integers(2, 9)))

    def card() -> str:
        x = pick("4", "5", "3") + num(14)
        return next(x + c for c in "0123456789" if luhn(x + c))

    def entity(kind: int) -> tuple[str, str]:
        """What stands before, and the entity."""
        if kind == 0:
            who, host, top = pick(word(), word() + num(2), word() + "." + word()), word(), pick("com", "org", "net")
            if rng.random() < 0.4:
                return "", f"{who}@{host}.{top}"
            at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" AT ", " DOT "))
            return "", f"{who}{at}{host}{dot}{top}"
        if kind == 1:
            return "", ".".join(str(rng.integers(1, 256)) for _ in range(4))
        if kind == 2:
            c = card()
            sep = pick("", " ", "-")
            return "", sep.join(c[k : k + 4] for k in range(0, 16, 4))
        if kind == 3:
            a, b, c = num(3), num(3), num(4)
            return "", pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b} {c}")
        which = int(rng.integers(3))
        if which == 0:
            return "", "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        body = letters(int(rng.integers(18, 41)), "0123456789abcdef")
        if rng.random() < 0.5:
            # keys of any alphabet and length; their ends are word boundaries, and some digit is in them
            n, more = int(rng.integers(40, KEY_CHARS)), pick("", "+/", "-_")
            of = pick("0123456789abcdef", _WORD_CHARS + more)
            body = letters(1, _WORD_CHARS) + letters(n // 2, of) + num(1) + letters(n - n // 2, of) + letters(1, _WORD_CHARS)
        return pick("password=", 'token = "', "secret: ", "api_key=", "key = "), body

    def lookalike() -> str:
        return pick(f"version {num(1)}.{num(1)}", f"20{num(2)}", f"20{num(2)}-{pick('01', '11')}-{num(2)}", num(int(rng.integers(1, 7))), num(8), num(12), num(15), num(16), num(22), f"{num(1)},{num(3)},{num(3)}", f"{num(2)}.{num(2)}", f"{num(3)} {num(3)}", f"{word()} dot {word()}", f"@{word()}", f"{word()}{num(2)}", f"{num(4)} {num(4)}", f"{num(1)}.{num(1)}.{num(1)}", f"{word()} at {num(2)}", f"{num(4)}-{num(4)}")

    text, spans = "", []
    for _ in range(int(rng.integers(4, 9))):
        draw = rng.random()
        if draw < 0.3:
            kind = int(rng.integers(len(KINDS)))
            before, e = entity(kind)
            text += before
            spans.append((len(text), len(text) + len(e), kind))
            text += e + ('"' if before.endswith('"') else pick("", "", ".", ","))
        else:
            x = lookalike()
            if draw < 0.5 and not (x.isdigit() and len(x) == 16 and luhn(x)):
                text += x + pick("", "", ".", ",")
            else:
                text += word() + pick("", ".", ",")
        # a word keeps numbers that follow each other apart
        text += " " + word() + " "
    return text.strip(), spans


@cache
def model(samples: int = 320, epochs: int = 6, seed: int = 7) -> SemiCRF:
    """The CRF, trained by AdaGrad on the likelihood of generated lines, with a quadratic penalty."""
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < samples:
        text, spans = _generate(rng)
        lat = Lattice(text)
        starts, ends = {a: k for k, (a, _) in enumerate(lat.tokens)}, {b: k + 1 for k, (_, b) in enumerate(lat.tokens)}
        gold = [(starts.get(a, -1), ends.get(b, -1), k) for a, b, k in spans]
        if lost := {(s, e) for s, e, _ in gold} - set(lat.segments):
            raise ValueError(f"no candidate for {lost} in generated text {text!r}")
        data.append((lat, gold))
    crf = SemiCRF()
    gw, gm = np.full_like(crf.weights, 1e-2), np.full_like(crf.moves, 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            _, dw, dm = crf.gradient(*data[k])
            dw, dm = dw - 1e-3 * crf.weights, dm - 1e-3 * crf.moves
            gw += dw**2
            gm += dm**2
            crf.weights += 0.5 * dw / np.sqrt(gw)
            crf.moves += 0.5 * dm / np.sqrt(gm)
    return crf


# -- on documents --


def find(text: str | None, zone_spans) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start. ``zone_spans``: what stands before a zone, the zone, and what stands
    after it -> [(kind number, start, end) in the zone]."""
    if not text:
        return []
    base = base_spans(text)
    found = [(k, a, b, True) for k in BASE_KINDS for a, b in base[k]]
    starts, ends = [], []  # of the base spans' union, ascending
    for a, b in sorted((a, b) for _, a, b, _ in found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for lo, hi in zones(text):
        for kind, a, b in zone_spans((text[max(0, lo - BEFORE) : lo], text[lo:hi], text[hi : hi + 1])):
            a, b = a + lo, b + lo
            k = bisect_right(ends, a)
            if k == len(starts) or starts[k] >= b:
                found.append((KINDS[kind], a, b, False))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def _decoder(crf: SemiCRF):
    def spans(seen: tuple[str, str, str]) -> list[tuple[int, int, int]]:
        before, zone, after = seen
        lo = len(before)
        lat = Lattice(before + zone + after, lo, lo + len(zone))
        return [(k, lat.tokens[s][0] - lo, lat.tokens[e - 1][1] - lo) for s, e, k in crf.decode(lat)]

    # equal zones (copies of documents) are decoded once
    return WordCache(spans, SMALL_CACHE_BYTES, size=lambda seen, found: 200 + sum(map(len, seen)) + 120 * len(found))


def redact_text(text: str, zone_spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one.

    Repeated until nothing is found: each pass takes digits, at signs or spelled-out dots away and adds none.
    """
    while spans := sorted((a, b, k) for k, a, b, _ in find(text, zone_spans)):
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        text = "".join([*out, text[at:]])
    return text


def _column(text: Column, of_text, kind: pa.DataType, spark_kind: str) -> Column:
    """``of_text(text, decoder)`` of each text; workers keep what they have decoded."""
    crf, memo = model(), []

    def arrow(texts: pa.Array) -> pa.Array:
        memo[:] = memo or [_decoder(crf)]
        known, out = memo[0].take(), []
        for t in texts:
            out.append(of_text(t.as_py(), known.__getitem__))
            known.trim()
        return pa.array(out, kind)

    return F.arrow_udf(arrow, spark_kind)(text)


def entities(text: Column) -> Column:
    """Array of (kind, start, end, base) of a text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    return _column(text, lambda t, known: [{"kind": k, "start": a, "end": b, "base": f} for k, a, b, f in find(t, known)], kind, ENTITIES)


def redact(text: Column) -> Column:
    """A text without personal data; null stays null."""
    return _column(text, lambda t, known: t if t is None else redact_text(t, known), pa.string(), "string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", entities(F.col("text")).alias("e"))
    base = F.filter("e", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return x.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("e")).alias("spans"), F.size("e").cast("long").alias("n_spans"))
