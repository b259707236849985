"""Personal data: base patterns, and a semi-Markov conditional random field.

Base spans follow fixed patterns per kind and always stay. The field (Sarawagi and
Cohen, 2004) adds spans that the patterns miss, such as numbers without a leading plus
or addresses with ``(at)``. It segments a text's tokens: candidate spans of up to
``MAX_TOKENS`` tokens are scored as a whole for each kind, all other tokens are outside
on their own, labels of neighbouring segments have transition weights, and dynamic
programming over segments of bounded length chooses boundaries and kinds together.
Candidates hold seven digits and no letters, or are a dotted quad, or hold an ``@`` or
``(at)`` between the parts of an address, so tokens further than MAX_TOKENS from
any of these are outside under every segmentation and need no work: the whole text is
covered exactly. MAX_TOKENS is the longest form of an address with all marks spelled out. It is trained here by its exact likelihood on ``SENTENCES`` generated,
labelled sentences (seeded; a documented bound), once in the driver.

Added spans never overlap a base span. Of segmentations with one score, the one whose last
label comes later in the order of kinds is taken, then the one with the earlier start. Spans are in code points, end exclusive. A null
text counts as empty. Long texts are taken whole: running state is one number and one
back pointer a label and token near a trigger. Columns besides id and text are not
used, whatever their names; repeated rows and null ids come back as they are; an empty
table gives no rows.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from mediashoal.llm.arrow import map_text

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
MAX_CHARS = 120
SENTENCES = 240
EPOCHS = 12
RATE = 0.3
DECAY = 1e-4

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[] ?[aA][tT] ?[)\]]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\S\n]+|\n|.", re.DOTALL)
QUAD = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}")
AT = re.compile(r" ?[(\[] ?at ?[)\]] ?", re.IGNORECASE)
DOT = re.compile(r" ?[(\[] ?dot ?[)\]] ?", re.IGNORECASE)
PLAIN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CUES = {"phone": re.compile(r"(?:phone|tel|call|mobile|fax)\W{0,3}$", re.I), "card": re.compile(r"(?:card|visa|amex|credit)\W{0,3}$", re.I), "ip": re.compile(r"(?:ip|host|server|address)\W{0,3}$", re.I), "email": re.compile(r"(?:mail|write to|contact)\W{0,3}$", re.I)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # the class of the local part has no @, so each @ has one leftmost start
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def clear(s: str) -> str:
    """With spelled-out marks as themselves."""
    return DOT.sub(".", AT.sub("@", s))


def features(text: str, start: int, end: int) -> list[float]:
    """Of a candidate span as a whole, with one character and a cue beside it."""
    s = text[start:end]
    d = _digits(s)
    n, before, after = len(d), text[start - 1 : start] if start else "", text[end : end + 1]
    groups = re.findall(r"[0-9]+", s)
    plain = clear(s)
    email = bool(PLAIN.fullmatch(plain))
    letters = any(c.isalpha() for c in s)
    quad = len(groups) == 4 and not letters and bool(re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}", s))
    lead = text[max(0, start - 16) : start]
    return [
        1.0, email, email and plain != s, email and plain == s, email and len(plain.rpartition(".")[2]) in (2, 3, 4) and plain.rpartition(".")[2].isalpha(),
        "@" in plain and not email, quad and all(int(g) <= 255 for g in groups), len(groups) == 4 and s.count(".") == 3 and not quad,
        not letters and 16 <= n <= 19 and luhn(d), not letters and 16 <= n <= 19 and not luhn(d), not letters and n > 19,
        not letters and 9 <= n <= 12, not letters and n in (7, 8), not letters and n in (13, 14, 15), n < 7 and not email,
        s[0] == "+", s[0] == "(", "(" in s and ")" in s, s.count("(") != s.count(")"), len(groups) == 1, 2 <= len(groups) <= 5, len(groups) > 5,
        "-" in s, " " in s and not letters, "." in s and not letters, "/" in s or ":" in s or "," in s, "  " in s,
        bool(re.fullmatch(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", s)), bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*", s)),
        before.isalnum() or before in ("@", "_"), after.isalnum() or after in ("@", "_"), before in tuple(".-/+:#$\"'=") and before != "", after in tuple("-/:%\"'") and after != "",
        *[bool(CUES[k].search(lead)) for k in KINDS],
    ]


N_FEATURES = len(features("x 1234567", 2, 9))


class Lattice:
    """The tokens of one stretch of a text and its candidate spans, by first token."""

    def __init__(self, text: str, lo: int, hi: int):
        found = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        self.text, self.starts, self.ends = text, [a for a, _ in found], [b for _, b in found]
        self.n = len(found)

    def candidates(self, first: int, last: int) -> list[tuple[int, int]]:
        """(i, j): tokens i to j - 1, for i in [first, last)."""
        text, out = self.text, []
        for i in range(first, last):
            a = self.starts[i]
            head = text[a]
            if not (head.isascii() and head.isalnum()) and head not in "+(":
                continue
            digits = groups = at = 0
            letters = head_letters = head.isalpha()
            for j in range(i, min(self.n, i + MAX_TOKENS)):
                b = self.ends[j]
                c = text[self.starts[j]]
                if c == "\n" or b - a > MAX_CHARS:
                    break
                if "0" <= c <= "9":
                    digits += b - self.starts[j]
                    groups += 1
                elif c.isalpha():
                    letters = True
                    if text[self.starts[j] : b].lower() == "at" and text[self.starts[j] - 1] in "([ ":
                        at += 1
                elif c == "@":
                    at += 1
                if letters and not at and j - i > 12 or head_letters and not at and c.isspace() and text[b : b + 1] not in ("(", "["):
                    break
                if not (c.isascii() and c.isalnum()):
                    continue
                quad = groups == 4 and digits < 7 and not letters and not at and QUAD.fullmatch(text, a, b)
                if not letters and not at and digits >= 7 or quad or at == 1 and PLAIN.fullmatch(clear(text[a:b])):
                    out.append((i, j + 1))
        return out

    def features(self, spans: list[tuple[int, int]]) -> np.ndarray:
        rows = [features(self.text, self.starts[i], self.ends[j - 1]) for i, j in spans]
        return np.array(rows, np.float64).reshape(-1, N_FEATURES)


#: Labels: outside, then the kinds.
LABELS = len(KINDS) + 1


class SemiCRF:
    def __init__(self):
        self.weights = np.zeros((N_FEATURES, LABELS - 1))
        self.moves = np.zeros((LABELS, LABELS))

    def decode(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """The best segmentation's ``(kind, start, end)`` inside [lo, hi)."""
        lattice = Lattice(text, lo, hi)
        n, none = lattice.n, -1e30
        moves = self.moves.tolist()
        best = [0.0] + [none] * (LABELS - 1)  # by the label of the segment that ends here
        back: list[tuple | None] = [None]
        reach: dict[int, list] = {}
        into: dict[int, list] = {}
        for t in range(n + 1):
            if t:
                # outside, or one of the candidates that end here
                top, came = max((s + moves[y][0], y) for y, s in enumerate(best))
                now, links = [top] + [none] * (LABELS - 1), [(t - 1, came)] + [None] * (LABELS - 1)
                for i, scores in reach.pop(t, ()):
                    for y in range(1, LABELS):
                        s, came = into[i][y]
                        if s + scores[y - 1] > now[y]:
                            now[y], links[y] = s + scores[y - 1], (i, came)
                best = now
                back.append(tuple(links))
                into.pop(t - MAX_TOKENS - 1, None)
            if t < n:
                into[t] = [max((s + moves[p][y], p) for p, s in enumerate(best)) for y in range(LABELS)]
                if t % 512 == 0:
                    spans = lattice.candidates(t, min(n, t + 512))
                    if spans:
                        for (i, j), scores in zip(spans, (lattice.features(spans) @ self.weights).tolist(), strict=True):
                            reach.setdefault(j, []).append((i, scores))
        t, y, out = n, max(range(LABELS), key=best.__getitem__), []
        while t:
            i, came = back[t][y]
            if y:
                out.append((y - 1, lattice.starts[i], lattice.ends[t - 1]))
            t, y = i, came
        return out[::-1]

    def fit_one(self, text: str, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the log-likelihood of one labelled sentence."""
        lattice = Lattice(text, 0, len(text))
        n, spans = lattice.n, lattice.candidates(0, lattice.n)
        f = lattice.features(spans)
        scores = f @ self.weights
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(spans):
            by_end.setdefault(j, []).append(k)
            by_start.setdefault(i, []).append(k)
        alpha, into = np.full((n + 1, LABELS), -np.inf), np.full((n + 1, LABELS), -np.inf)
        alpha[0, 0] = 0
        sum_of = np.logaddexp.reduce
        for t in range(n + 1):
            if t:
                alpha[t, 0] = into[t - 1, 0]
                if t in by_end:
                    ks = by_end[t]
                    alpha[t, 1:] = sum_of(into[[spans[k][0] for k in ks], 1:] + scores[ks], axis=0)
            into[t] = sum_of(alpha[t][:, None] + self.moves, axis=0)
        total = sum_of(alpha[n])
        beta, ahead = np.full((n + 1, LABELS), -np.inf), np.full((n + 1, LABELS), -np.inf)
        beta[n] = 0
        for t in range(n - 1, -1, -1):
            ahead[t, 0] = beta[t + 1, 0]
            if t in by_start:
                ks = by_start[t]
                ahead[t, 1:] = sum_of(scores[ks] + beta[[spans[k][1] for k in ks], 1:], axis=0)
            beta[t] = sum_of(self.moves + ahead[t][None, :], axis=1)
        moves = -np.exp(alpha[:n, :, None] + self.moves[None] + ahead[:n, None, :] - total).sum(0)
        wrong = np.zeros_like(scores)
        if spans:
            i, j = np.array(spans).T
            wrong = -np.exp(into[i, 1:] + scores + beta[j, 1:] - total)
        place = {(lattice.starts[i], lattice.ends[j - 1]): k for k, (i, j) in enumerate(spans)}
        ends = {lattice.starts[i]: i for i in range(n)}
        stops = {lattice.ends[i]: i + 1 for i in range(n)}
        t, last = 0, 0
        for kind, a, b in [*gold, (None, None, None)]:
            until = n if kind is None else ends[a]
            if until > t:
                moves[last, 0] += 1
                moves[0, 0] += until - t - 1
                last = 0
            if kind is not None:
                wrong[place[a, b], kind] += 1
                moves[last, kind + 1] += 1
                t, last = stops[b], kind + 1
        return f.T @ wrong, moves

    def train(self, sentences: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS) -> SemiCRF:
        """Adaptive gradient ascent, in the order given."""
        seen = [np.full_like(self.weights, 1e-2), np.full_like(self.moves, 1e-2)]
        for _ in range(epochs):
            for text, gold in sentences:
                for k, g in enumerate(self.fit_one(text, gold)):
                    w = (self.weights, self.moves)[k]
                    g = g - DECAY * w
                    seen[k] += g * g
                    w += RATE * g / np.sqrt(seen[k])
        return self


def sentences(n: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with personal data, look-alikes and neither, and the spans."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randrange(3, 8)))

    def card():
        d = num(rng.choice((15, 15, 15, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(("", " ", "-", "  ", ".", " - "))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(7)}", f"1-{a}-{b}-{c}", f"0{num(3)} {num(6)}", f"({a}){b}-{c}"))

    def email():
        at, dot = rng.choice((("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")))
        return f"{name()}{rng.choice(('', '.' + name(), num(2)))}{at}{name()}{rng.choice(('', dot + 'example'))}{dot}{rng.choice(('com', 'org', 'net', 'info', 'de'))}"

    def ip():
        return rng.choice((".", ".", "[.]", "(.)")).join(str(rng.randrange(256)) for _ in range(4))

    def other():
        return rng.choice((
            lambda: f"{rng.randrange(1900, 2100)}-{num(2)}-{num(2)}", lambda: num(rng.choice((4, 7, 9, 11, 13, 20, 24))), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: f"${num(3)},{num(3)}.{num(2)}", lambda: f"#{num(8)}", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}",
            lambda: f"{num(3)}-{num(2)}", lambda: f"@{name()}", lambda: f"{name()}@", lambda: f"{num(5)}/{num(5)}", lambda: f"{num(8)}-{num(4)}-{num(4)}-{num(12)}", lambda: f"{num(2)} {num(3)} {num(4)} {num(5)} {num(6)}",
            lambda: f"{num(10)}", lambda: f"{num(1)}.{num(9)}", lambda: f"token = \"{num(16)}\"", lambda: f"{name()} at {name()}",
        ))()

    makers, out = (email, ip, card, phone), []
    cues = (("mail", "write to"), ("ip", "server"), ("card", "visa"), ("call", "phone", "tel"))
    for _ in range(n):
        text, gold = name() + " " + name(), []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(-3, 4)
            if kind < 0:
                text += f" {other()}"
            else:
                text += rng.choice((" ", " ", f" {rng.choice(cues[kind])} ", f" {rng.choice(cues[kind])}: ", ", ", " ("))
                span = makers[kind]()
                gold.append((kind, len(text), len(text) + len(span)))
                text += span
            text += rng.choice((" ", ", ", ". ", ") ")) + name()
        out.append((text, gold))
    return out


def _usable(made: list) -> list:
    """Without sentences of which a gold span is no candidate (a name that is ``at``)."""
    out = []
    for text, gold in made:
        lattice = Lattice(text, 0, len(text))
        have = {(lattice.starts[i], lattice.ends[j - 1]) for i, j in lattice.candidates(0, lattice.n)}
        if all((a, b) in have for _, a, b in gold):
            out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCRF:
    return SemiCRF().train(_usable(sentences(SENTENCES)))


def _run(c: str) -> str:
    """The kind of token that a character makes with its like."""
    return "a" if c.isascii() and c.isalpha() else "0" if "0" <= c <= "9" else " " if c != "\n" and c.isspace() else ""


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a candidate may lie: around each trigger, at most MAX_CHARS to either side,
    and never over a line end. A run of letters, digits or blanks that a side would cut
    is left out there, as it reaches further than a candidate can."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1] - MAX_CHARS:
            continue
        lo, hi = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        while 0 < lo < m.start() and _run(text[lo]) and _run(text[lo]) == _run(text[lo - 1]):
            lo += 1
        while m.end() < hi < len(text) and _run(text[hi]) and _run(text[hi]) == _run(text[hi - 1]):
            hi -= 1
        lo = text.rfind("\n", lo, m.start()) + 1 or lo
        cut = text.find("\n", m.end(), hi)
        hi = hi if cut < 0 else cut
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def find(text: str, model: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, both by kind and start."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added = [s for lo, hi in stretches(text) for s in model.decode(text, lo, hi)]
    if added and base:
        taken = sorted((a, b) for _, a, b in base)
        starts, tops = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken])
        free = []
        for s in added:
            k = int(np.searchsorted(starts, s[2])) - 1  # the last base span that starts before its end
            if k < 0 or tops[k] <= s[1]:
                free.append(s)
        added = free
    return base, sorted(base + added)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_all(docs: DataFrame, ident: str = "doc_id", text: str = "text", model: SemiCRF | None = None) -> DataFrame:
    """``(ident, n_email, n_ip, n_card, n_phone, base, spans, n_spans, n_added)``; spans as
    strings. The first four count base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def kernel():
        fixed = shared.value

        def one(t: str) -> tuple:
            base, spans = find(t, fixed)
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            return (*counts, spelled(base), spelled(spans), len(spans), len(spans) - len(base))

        return one

    return map_text(docs, ident, text, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, n_spans bigint, n_added bigint", kernel)
