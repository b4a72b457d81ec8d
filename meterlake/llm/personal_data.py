"""PII: fixed patterns, and a semi-Markov conditional random field over whole candidate spans.

Around digits and @ signs a text is cut into tokens; every run of up to `LONGEST` tokens that holds a digit or
an @ is a segment that may be one entity or, token by token, none. Features look at the whole span (digits,
separators, octets, check digit, @ and dots, ends, cue words before it) and score it for each kind; the entity
is bounded in tokens, so dynamic programming finds the best boundaries and kinds together in linear time,
and sums over all segmentations in training. Features are counted by prefix sums over all segments at once, in blocks
of tokens, so a long text costs a few bytes a token and no more.

Weights maximise the conditional likelihood of labelled segmentations. Labels are made: entities by rules of their
formats, with the spellings that the patterns lack (numbers without a plus sign, cards with a slipped digit or other
separators, addresses with blanks or brackets round the @), and look-alikes that are none (dates, prices, versions,
sums, serial numbers), set at places of a bounded sample of documents; the sample's own stretches count too, with the
patterns' findings as entities. A third is kept aside for `recall` and `precision`. Spans that the best segmentation
holds and that overlap no pattern's are added with kind `field_<kind>`.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .spans import Cover, Span, sample_texts, scan_with

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"field_{k}" for k in BASE)]
#: Documents that the field is fitted on at most, characters of each, and stretches made and taken from them.
SAMPLE, SAMPLE_CHARS, MADE, TAKEN = 600, 4000, 420, 160
LONGEST = 16
REACH = 24
#: Tokens whose segments are scored at once.
BLOCK = 2048

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]{2}|@")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^\sA-Za-z0-9]")
#: Words that stand before personal data, by kind.
_CUES = {"mail": 1, "email": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "card": 3, "visa": 3, "payment": 3, "tel": 4, "phone": 4, "call": 4, "mobile": 4, "fax": 4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def regions(text: str):
    """Stretches around triggers, joined where they touch."""
    here = None
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if here and s <= here[1]:
            here = here[0], e
        else:
            if here:
                yield here
            here = s, e
    if here:
        yield here


class Lattice:
    """Tokens of a stretch of text and, for any block of them, the features of the segments that begin there."""

    def __init__(self, text: str, lo: int, hi: int):
        part = text[lo:hi]
        self.bounds = np.array([*(m.start() for m in _TOKEN.finditer(part)), len(part)])
        self.lo, self.n = lo, len(self.bounds) - 1
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        digit, blank = (c >= 48) & (c <= 57), (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0)
        letter = ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122)) | (c > 191)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        sums = {"digit": digit, "blank": blank, "letter": letter, "at": c == 64, "dot": c == 46, "dash": c == 45, "bracket": (c == 40) | (c == 41), "line": c == 10, "odd": ~(digit | blank | letter | np.isin(c, [32, 40, 41, 43, 45, 46, 37, 64, 91, 93, 95]))}
        self.sums = {k: total(v) for k, v in sums.items()}
        value = np.where(digit, c.astype(np.int64) - 48, 0)
        rank = self.sums["digit"][:-1]
        double = np.where(value > 4, 2 * value - 9, 2 * value)
        self.check = [total(np.where(digit, np.where(rank % 2 == k, double, value), 0)) for k in (0, 1)]
        self.ats = np.flatnonzero(c == 64)
        self.code = np.concatenate([[10], c, [10]])  # code[i + 1] is the character at i
        first = c[self.bounds[:-1]]
        size = np.diff(self.bounds)
        number = (first >= 48) & (first <= 57)
        small = number & (size <= 3) & np.array([number[i] and size[i] <= 3 and int(part[self.bounds[i] : self.bounds[i + 1]]) <= 255 for i in range(self.n)], bool)
        point = (first == 46) & (size == 1)
        pad = np.zeros(8, bool)
        a, b = np.concatenate([small, pad]), np.concatenate([point, pad])
        n = self.n
        self.octets = a[:n] & b[1 : n + 1] & a[2 : n + 2] & b[3 : n + 3] & a[4 : n + 4] & b[5 : n + 5] & a[6 : n + 6]
        cue, self.cue = 0, np.zeros(n, np.int8)
        for i in np.flatnonzero((first > 64) & (first < 123)).tolist():
            cue = _CUES.get(part[self.bounds[i] : self.bounds[i + 1]].lower(), 0)
            if cue:
                self.cue[i + 1 : i + 5] = cue
        self.white = blank[self.bounds[:-1]]

    def segments(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments that begin at tokens a..b: first token, last token + 1, features (the last is a bias)."""
        i = np.repeat(np.arange(a, b), LONGEST)
        j = i + np.tile(np.arange(1, LONGEST + 1), b - a)
        keep = j <= self.n
        i, j = i[keep], j[keep]
        s, e = self.bounds[i], self.bounds[j]
        count = lambda k: self.sums[k][e] - self.sums[k][s]
        keep = (count("digit") + count("at") > 0) & (count("line") == 0) & ~self.white[i] & ~self.white[j - 1]
        i, j, s, e = i[keep], j[keep], s[keep], e[keep]
        d, at, dot, blank, letter, dash, bracket = (count(k) for k in ("digit", "at", "dot", "blank", "letter", "dash", "bracket"))
        even = (self.sums["digit"][e] & 1) == 0
        doubled = np.where(even, self.check[0][e] - self.check[0][s], self.check[1][e] - self.check[1][s])
        valid = (doubled % 10 == 0) & (d > 0)
        where = self.ats[np.minimum(self.sums["at"][s], max(0, len(self.ats) - 1))] if len(self.ats) else np.zeros(len(s), np.int64)
        one = at == 1
        local, domain = one & (where > s), one & (where + 1 < e)
        tail = self.sums["dot"][e] - self.sums["dot"][np.minimum(where + 1, e)]
        start, end, before, after = self.code[s + 1], self.code[e], self.code[s], self.code[e + 1]
        alnum = lambda x: ((x >= 48) & (x <= 57)) | ((x >= 65) & (x <= 90)) | ((x >= 97) & (x <= 122)) | (x > 191)
        octets = self.octets[i] & (j - i == 7)
        pure = (letter == 0) & (at == 0)
        plain = pure & (count("odd") == 0)
        cue = self.cue[i]
        length = e - s
        x = np.stack([
            local & domain & (tail > 0), local & domain & (tail > 0) & (blank == 0), at > 1, one & ~(local & domain & (tail > 0)), one & (end != 46) & alnum(end) & alnum(start), letter * (at == 0) > 0, (letter > 0) & (at == 0) & (d > 0),
            octets, octets & ~alnum(before) & ~alnum(after) & (before != 46), plain & (dot == 3) & ~octets,
            (start == 43) & plain, (start == 43) & plain & (d >= 9) & (d <= 15), plain & (start == 40) & (d >= 9) & (d <= 11), plain & (d >= 9) & (d <= 11) & (dash + blank >= 2) & (dot == 0), plain & (d >= 9) & (d <= 11) & (length == d), plain & (d < 7), plain & (d == 10) & (bracket == 2),
            plain & (d >= 12) & (d <= 19) & (dot == 0) & (start != 43), plain & (d == 16) & (start != 43) & (dot == 0), plain & (d >= 12) & (d <= 19) & valid, plain & (d == 16) & (start >= 51) & (start <= 54), plain & (d > 19),
            alnum(before), alnum(after), (before == 43) | (before == 36) | (before == 35) | (before == 46), (after == 37) | ((after == 46) & alnum(self.code[np.minimum(e + 2, len(self.code) - 1)])), ~alnum(end), ~alnum(start) & (start != 43) & (start != 40), count("odd") > 0,
            cue == 1, cue == 2, cue == 3, cue == 4, blank > 3, length / 20.0, np.ones(len(s)),
        ], axis=1).astype(float)
        return i, j, x


N_FEATURES = Lattice("1", 0, 1).segments(0, 1)[2].shape[1]


# --------------------------------------------------------------------------- labelled segmentations


def _entity(r: random.Random) -> tuple[str, int]:
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randrange(3, 9)))
    kind = r.randrange(4)
    if kind == 0:
        local = r.choice([name(), f"{name()}.{name()}", f"{name()}{n(2)}", f"{name()}_{n(1)}"])
        at = r.choice(["@", "@", " @ ", "@ "]) if r.random() < 0.6 else "@"
        return f"{local}{at}{name()}.{r.choice(['com', 'org', 'co.uk', 'de', 'example.net'])}", 0
    if kind == 1:
        return ".".join(str(r.randrange(256)) for _ in range(4)), 1
    if kind == 2:
        d = r.choice("3456") + n(r.choice([15, 15, 15, 14]))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4)), 2
    area, a, b = n(3), n(3), n(4)
    return r.choice([f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{r.randrange(20, 99)} {area} {a}{b}", f"+{r.randrange(20, 99)}{area}{a}{b}", f"{area} {a} {b}", f"0{area}/{a}{b}"]), 3


def _lookalike(r: random.Random) -> str:
    return r.choice([
        f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1900, 2030)}", f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{r.randrange(1900, 2000)}-{r.randrange(2000, 2030)}", f"${r.randrange(10, 9999)}.{r.randrange(100):02}",
        f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}", f"{r.randrange(10, 99)}%", f"{r.randrange(10**3, 10**8):,}", f"#{r.randrange(10**4, 10**9)}", f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}", f"{r.randrange(10**20, 10**24)}", f"@{r.choice(['home', 'noon', 'the'])}",
        f"{r.randrange(10, 99)} {r.randrange(10, 99)} {r.randrange(10, 99)} {r.randrange(10, 99)} {r.randrange(10, 99)} {r.randrange(10, 99)}", f"978-{r.randrange(10)}-{r.randrange(10**5):05}-{r.randrange(10**3):03}-{r.randrange(10)}", f"{r.random() * 100:.6f}", f"{r.randrange(300, 999)}.{r.randrange(300, 999)}.{r.randrange(10)}.{r.randrange(10)}",
    ])


_LEADS = ["", "", "mail ", "contact: ", "call ", "phone ", "tel. ", "card ", "ip ", "host ", "no. ", "see ", "on ", "for "]


def stretches(texts: list[str], made: int = MADE, taken: int = TAKEN, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Texts with their labelled spans."""
    r = random.Random(seed)
    texts = [t for t in texts if t and t.strip()] or ["in the town of the old mill a man was to be seen on the road"]
    out: list[tuple[str, list[Span]]] = []
    for k in range(made):
        t = r.choice(texts)
        at = t.rfind(" ", 0, r.randrange(len(t) + 1)) + 1
        left = re.sub(r"[0-9@\n]", " ", t[max(0, at - REACH) : at]) + r.choice(_LEADS)
        right = r.choice([" ", ", ", ". ", "! ", ") ", "\n", ""]) + re.sub(r"[0-9@]", " ", t[at : at + REACH])
        if k % 3 == 2:
            out.append((left + _lookalike(r) + right, []))
        else:
            x, kind = _entity(r)
            out.append((left + x + (right if not right[:1].isalnum() else " " + right), [(len(left), len(left) + len(x), BASE[kind])]))
    real = [(t, s, e) for t in texts for s, e in regions(t) if e - s < 400]
    for t, s, e in r.sample(real, min(taken, len(real))):
        part = t[s:e]
        spans = base_spans(part)
        # A long number that no pattern takes is left open rather than taught as nothing.
        if not any(m.end() - m.start() >= 12 for m in re.finditer(r"[0-9]+", part) if not Cover(spans).meets(m.start(), m.end())):
            out.append((part, spans))
    r.shuffle(out)
    return out


class Field:
    def __init__(self, labelled: list[tuple[str, list[Span]]], rounds: int = 6, rate: float = 0.25):
        self.w = np.zeros((4, N_FEATURES))
        self.recall = self.precision = 0.0
        aside, used = labelled[: len(labelled) // 3], labelled[len(labelled) // 3 :]
        data = []
        for text, spans in used:
            lattice = Lattice(text, 0, len(text)) if text else None
            if not lattice or not lattice.n:
                continue
            i, j, x = lattice.segments(0, lattice.n)
            at = {(int(lattice.bounds[a]), int(lattice.bounds[b])): k for k, (a, b) in enumerate(zip(i, j))}
            data.append((lattice.n, i, j, x, [(at[s, e], BASE.index(k)) for s, e, k in spans if (s, e) in at]))
        step = np.full_like(self.w, 1e-6)
        for _ in range(rounds):
            for n, i, j, x, gold in data:
                g = -1e-3 * self.w - self.expected(n, i, j, x).T @ x
                for k, kind in gold:
                    g[kind] += x[k]
                step += g * g
                self.w += rate * g / np.sqrt(step)
        want = {(n, *s) for n, (_, spans) in enumerate(aside) for s in spans}
        got = {(n, s, e, k.removeprefix("field_")) for n, (text, _) in enumerate(aside) for s, e, k in self.decode(text)}
        if want and got:
            self.recall, self.precision = len(want & got) / len(want), len(want & got) / len(got)

    def expected(self, n: int, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(segment is an entity of the kind), by sums over all segmentations."""
        s = x @ self.w.T
        top = s.max(axis=1, initial=0.0)
        total = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) if len(s) else top
        grid = np.full((n + 1, LONGEST + 1), -np.inf)  # grid[a, l]: segment of l tokens from a
        grid[i, j - i] = total
        f, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        f[0] = b[n] = 0.0
        for k in range(1, n + 1):
            lo = max(0, k - LONGEST)
            v = f[lo:k] + grid[np.arange(lo, k), k - np.arange(lo, k)]
            v[-1] = np.logaddexp(v[-1], f[k - 1])
            m = v.max()
            f[k] = m + np.log(np.exp(v - m).sum())
        for k in range(n - 1, -1, -1):
            hi = min(n, k + LONGEST)
            v = b[k + 1 : hi + 1] + grid[k, 1 : hi - k + 1]
            v[0] = np.logaddexp(v[0], b[k + 1])
            m = v.max()
            b[k] = m + np.log(np.exp(v - m).sum())
        return np.exp(s + (f[i] + b[j] - f[n])[:, None])

    def decode(self, text: str) -> list[Span]:
        out = []
        for lo, hi in regions(text):
            lattice = Lattice(text, lo, hi)
            n = lattice.n
            grid = np.full((n + LONGEST, LONGEST), -np.inf, np.float32)  # grid[b + LONGEST - 1, l - 1]: segment of l tokens up to b
            kind = np.zeros((n + 1, LONGEST), np.int8)
            for a in range(0, n, BLOCK):
                i, j, x = lattice.segments(a, min(n, a + BLOCK))
                s = x @ self.w.T
                if len(s):
                    grid[j, j - i - 1], kind[j, j - i - 1] = s.max(axis=1), s.argmax(axis=1)
            if not (grid > 0).any():
                continue
            best, back = np.zeros(n + LONGEST + 1), np.zeros(n + 1, np.int8)  # best[k + LONGEST]: of the first k tokens
            best[:LONGEST] = -np.inf
            some = (grid > 0).any(axis=1)
            for k in range(1, n + 1):
                best[k + LONGEST] = best[k + LONGEST - 1]
                if some[k]:
                    v = best[k + LONGEST - 1 : k - 1 : -1] + grid[k]
                    m = int(v.argmax())
                    if v[m] > best[k + LONGEST]:
                        best[k + LONGEST], back[k] = v[m], m + 1
            k = n
            while k > 0:
                size = int(back[k])
                if size:
                    out.append((int(lattice.bounds[k - size]) + lo, int(lattice.bounds[k]) + lo, f"field_{BASE[kind[k, size - 1]]}"))
                k -= size or 1
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Field from labelled segmentations in the contexts of some `sample` documents (`SAMPLE_CHARS` of each)."""
    return Field(stretches(sample_texts(docs, sample, SAMPLE_CHARS)))


def scan_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them).

    One row per row, repeated ones too; null and empty texts have none; no rows: no rows. Texts are read whole; one made
    of digits is a single stretch whose lattice takes some 100 bytes a token. No shuffle.
    """

    def scan(texts: list[str]):
        out = []
        for text in texts:
            base = base_spans(text)
            cover = Cover(base)
            out.append((base, [x for x in field.decode(text) if not cover.meets(x[0], x[1])]))
        return out

    needed = np.zeros(256, bool)
    needed[[*range(48, 58), ord("@")]] = True
    return scan_with(docs, scan, BASE, KINDS, needed)
