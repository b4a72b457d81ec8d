"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of 16 or more token characters. The network reads all of it in windows of `BODY` characters,
each with the `SIDE` characters before and behind it; a candidate's score is its best window's.

The network is trained in numpy on labelled findings. Positives are credentials made by rules of their formats (keys,
tokens, connection strings, hashes), set in real contexts: at places of a bounded sample of documents, behind the words
that go before them in practice. Negatives are the sample's own candidates that no pattern marks, and made
ones that look alike: identifiers, paths, addresses, version and serial numbers, compounds, capitals, placeholders.
The sampled documents fall into three sets. Contexts of three fifths are fitted on. On findings in another fifth, also behind words
that the fit doesn't know, scores are calibrated (logistic scaling), and each shape of candidate (hexadecimal, letters and digits,
with punctuation, letters alone) gets the highest threshold at which `RECALL` of its positives are found, with two standard errors in hand.
Recall and false findings are measured on the last fifth, behind words that neither of the others knows.
Findings of the network that overlap no pattern's are added with kind `network`.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame

from .spans import Cover, Span, sample_texts, scan_with

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "network"]
#: Documents that the network is fitted on at most, characters of each, and findings of each label.
SAMPLE, SAMPLE_CHARS, FINDINGS = 1500, 4000, 1200
#: Fit alone: sampled documents and words of each that made negatives are put together from, and pattern findings a document
#: that count as positives, as long as there are fewer than `LABELLED` windows.
LEXICON_TEXTS, LEXICON_WORDS, FINDINGS_A_TEXT, LABELLED = 300, 200, 2, 5 * FINDINGS
RECALL = 0.95
SIDE, BODY, STRIDE = 24, 48, 32
#: Windows scored at once.
BATCH = 512

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_CODE = np.zeros(0x110000, np.uint8)
_CODE[33:127] = np.arange(2, 96)
_CODE[[32, 9, 10, 13]] = 1
_CODE[127:] = 96


def base_spans(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def shape(run: str) -> int:
    """0 hexadecimal, 1 letters and digits, 2 with punctuation, 3 letters alone."""
    if run.isalpha():
        return 3
    if run.isalnum():
        return 0 if not set(run.lower()) - set("0123456789abcdef") else 1
    return 2


def windows(text: str, start: int, end: int):
    """Codes of the windows over a candidate; the last ends where it ends."""
    last = max(start, end - BODY)
    for at in [*range(start, last, STRIDE), last]:
        body = text[at : min(end, at + BODY)]
        s = text[max(0, at - SIDE) : at].rjust(SIDE) + body.ljust(BODY) + text[at + len(body) : at + len(body) + SIDE].ljust(SIDE)
        yield _CODE[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]


# --------------------------------------------------------------------------- labelled findings

_BEFORE = [
    "key: ", "Authorization: Bearer ", "export KEY=", "-H 'X-Auth: ", "credentials ", "login with ", "aws_secret_access_key ", "private key ", "pass: ", "pwd=", "sig=", "access ", "auth ", 'value="', "id_rsa ",
    "session ", "client_id ", "webhook ", "bearer ", "signed ", "://admin:", "the new key is ", "use ", "KEY ", "",
]


#: Words that go before in the set that calibrates, beside those of the fit, and in the set that measures.
_BEFORE_ASIDE = ["enter ", "it is now ", "api: ", "cookie=", "(", "uses ", "sent "]
_BEFORE_MEASURED = ["the new value is ", "set to ", "please store ", " -> ", "header x-y: ", "copy this ", "as given: "]


def _positive(r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    both, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    kind = r.randrange(9)
    if kind == 0:
        return pick("0123456789abcdef", r.choice([16, 20, 24, 28, 30])) if r.random() < 0.5 else pick("0123456789ABCDEF", r.choice([24, 32, 40, 64]))
    if kind == 1:
        return r.choice(["gh", "gl", "sk", "pk", "rk", "xox", "npm", "dop"]) + r.choice(["p_", "o_", "_live_", "-", "_test_", "b-"]) + pick(both, r.randrange(16, 40))
    if kind == 2:
        return pick(b64, r.randrange(22, 60)) + "=" * r.randrange(3)
    if kind == 3:
        return "eyJ" + pick(both, r.randrange(14, 30)) + ".eyJ" + pick(both, r.randrange(14, 60)) + "." + pick(both + "-_", r.randrange(20, 44))
    if kind == 4:
        return pick(string.ascii_uppercase + string.digits, r.randrange(16, 33))
    if kind == 5:
        return pick(both, r.randrange(16, 48))
    if kind == 6:
        return pick(both + "-_", r.randrange(24, 64))
    if kind == 7:
        return pick(string.digits, r.randrange(8, 12)) + "-" + pick(string.ascii_lowercase + string.digits, r.randrange(24, 34))
    return pick(string.ascii_letters, r.randrange(18, 36))


def _negative(r: random.Random, words: list[str]) -> str:
    w = lambda: r.choice(words)
    kind = r.randrange(11)
    if kind == 0:
        return "_".join(w().lower() for _ in range(r.randrange(3, 6)))
    if kind == 1:
        return "".join(w().title() for _ in range(r.randrange(3, 6)))
    if kind == 2:
        return "/" + "/".join(w().lower() for _ in range(r.randrange(3, 6))) + r.choice([".py", ".html", ".txt", "", ".json"])
    if kind == 3:
        return f"www.{w().lower()}-{w().lower()}.{r.choice(['com', 'org', 'de'])}/{w().lower()}/{r.randrange(2000, 2030)}"
    if kind == 4:
        return f"{w().lower()}-{r.randrange(20)}.{r.randrange(20)}.{r.randrange(99)}-{r.choice(['beta', 'rc1', 'x86_64', 'linux'])}.tar.gz"
    if kind == 5:
        return f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}-{r.randrange(24):02}-{r.randrange(60):02}-{w().lower()}"
    if kind == 6:
        return r.choice("-=_.") * r.randrange(16, 60) if r.random() < 0.5 else r.choice(["x", "X", "your-", "a", "0"]) * r.randrange(4, 20) + r.choice(["here-please-fill-in", "xxxxxxxxxxxxxxxx", "replace-this-value"])
    if kind == 7:
        return "".join(w().lower() for _ in range(r.randrange(3, 7)))
    if kind == 8:
        return str(r.randrange(10**15, 10**19))
    if kind == 9:
        return "".join(w().upper() for _ in range(r.randrange(2, 5))) + r.choice(["", ".", ".", "-", "..."])
    return "-".join(w().lower() for _ in range(r.randrange(3, 7)))


def findings(texts: list[str], most: int = FINDINGS, seed: int = 5, before: list[str] = _BEFORE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Windows of labelled candidates, their labels and shapes: `most` made positives, as many made negatives and real candidates.

    Positives stand behind one of `before` or, three in ten, words of the documents; so do three in ten made negatives each.
    """
    r = random.Random(seed)
    texts = [t for t in texts if t] or ["in the town of the old mill a man was to be seen on the road"]
    words = [x for t in texts[:LEXICON_TEXTS] for x in t.split()[:LEXICON_WORDS] if 2 < len(x) < 10 and x.isascii() and x.isalpha()] or ["mill", "town", "road"]
    out: list[np.ndarray] = []
    labels, shapes = [], []

    def add(text: str, s: int, e: int, label: bool) -> None:
        for w in windows(text, s, e):
            out.append(w)
            labels.append(label)
            shapes.append(shape(text[s:e]))
            if label:
                break  # of a long positive the first window, as any of them is enough

    for k in range(2 * most):
        t = r.choice(texts)
        at = r.randrange(len(t) + 1)
        at = max(t.rfind(" ", 0, at) + 1, 0)
        made = _positive(r) if k % 2 else _negative(r, words)
        if len(made) < 16:
            continue
        u = r.random()
        plain = " ".join(r.choice(words) for _ in range(r.randrange(1, 4))) + r.choice([" ", " ", ": ", "=", " is "])
        lead = plain if u < 0.3 else r.choice(before) if k % 2 or u < 0.6 else ""
        left, right = t[max(0, at - SIDE) : at] + lead, r.choice(["", " ", '"', "'", ", ", "\n", "@host "]) + t[at : at + SIDE]
        if not k % 2 and right[:1] not in (" ", "\n"):
            right = " " + right
        add(left + made + right, len(left), len(left) + len(made), bool(k % 2))
    real = [(t, s, e) for t in texts for cover in [Cover(base_spans(t))] for s, e in candidates(t) if not cover.meets(s, e)]
    for t, s, e in r.sample(real, min(most, len(real))):
        add(t, s, e, False)
    for t in texts:
        for s, e, kind in base_spans(t)[:FINDINGS_A_TEXT]:
            if kind != "assign" and len(labels) < LABELLED:
                add(t, s, e, True)
    return out, np.array(labels, bool), np.array(shapes)


class Network:
    """Embedding, convolution of width 5, maxima over what is before, in and behind the body, logistic output."""

    PARTS = ((0, SIDE - 2), (SIDE - 2, SIDE + BODY - 2), (SIDE + BODY - 2, 2 * SIDE + BODY - 4))

    def __init__(self, found: list[np.ndarray], labels: np.ndarray, shapes: np.ndarray, seed: int = 3, dim: int = 8, filters: int = 16, rounds: int = 600, aside=None, measured=None):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.p = [r.normal(0, 0.3, (97, dim)).astype(f32), r.normal(0, 0.2, (5 * dim, filters)).astype(f32), np.zeros(filters, f32), r.normal(0, 0.2, 3 * filters).astype(f32), np.zeros(1, f32)]
        self.scale, self.thresholds, self.recall, self.false = (1.0, 0.0), np.full(4, 0.5), 0.0, 0.0
        x = np.stack(found)
        used = r.permutation(len(labels))
        if aside is None:  # one set of documents alone: a third of its findings
            third, used = used[: len(used) // 3], used[len(used) // 3 :]
            aside = x[third], labels[third], shapes[third]
        state = [[np.zeros_like(w), np.zeros_like(w)] for w in self.p]
        for k in range(1, rounds + 1):
            batch = used[r.integers(0, len(used), 192)]
            for i, (w, g) in enumerate(zip(self.p, self._gradient(x[batch], labels[batch]))):
                m, v = state[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (0.02 * (1.02 - k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(f32)
        self._calibrate(self._all_logits(aside[0]), *aside[1:])
        found, y, shapes = measured or aside
        hit = self.probability(self._all_logits(found)) >= self.thresholds[shapes]
        self.recall, self.false = float(hit[y].mean()) if y.any() else 0.0, float(hit[~y].mean()) if (~y).any() else 0.0
        self.recalls = [float(hit[y & (shapes == k)].mean()) if (y & (shapes == k)).any() else 0.0 for k in range(4)]

    def _all_logits(self, found) -> np.ndarray:
        return np.concatenate([self.logits(np.stack(found[i : i + BATCH])) for i in range(0, len(found), BATCH)])

    def _calibrate(self, z: np.ndarray, y: np.ndarray, shapes: np.ndarray) -> None:
        """Logistic scaling of what was kept aside, and by shape the highest threshold that finds `RECALL` of its positives, with two standard errors in hand."""
        design, w = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
        target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))  # never quite sure

        def loss(w):
            m = design @ w
            return (np.logaddexp(0, m) - target * m).sum() + 0.5 * ((w - [1.0, 0.0]) ** 2).sum()

        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2)
            step, before = np.linalg.solve(h, design.T @ (target - p) - (w - [1.0, 0.0])), loss(w)
            while loss(w + step) > before and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
        self.scale = float(w[0]), float(w[1])
        p = self.probability(z)
        for k in range(4):
            good = np.sort(p[y & (shapes == k)])
            good = good if len(good) >= 20 else np.sort(p[y])
            if len(good):
                missed = (1 - RECALL) * len(good)
                self.thresholds[k] = good[int(max(0.0, missed - 2 * (RECALL * missed) ** 0.5))]

    def _forward(self, w):
        e, conv, bias, out, off = self.p
        x = e[w]
        n, length, dim = x.shape
        cols = np.concatenate([x[:, k : length - 4 + k] for k in range(5)], axis=2)
        h = np.maximum(cols @ conv + bias, 0)
        at = [a + h[:, a:b].argmax(axis=1) for a, b in self.PARTS]
        z = np.concatenate([np.take_along_axis(h, a[:, None], 1)[:, 0] for a in at], axis=1)
        return cols, at, z, z @ out + off

    def _gradient(self, w, y):
        e, conv, bias, out, off = self.p
        cols, at, z, logit = self._forward(w)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        dz = d[:, None] * out * (z > 0)
        f = len(bias)
        de, dconv, dbias = np.zeros_like(e), np.zeros_like(conv), np.zeros_like(bias)
        for part, a in enumerate(at):
            g = dz[:, part * f : (part + 1) * f]
            dconv += np.einsum("nfd,nf->df", np.take_along_axis(cols, a[:, :, None], 1), g)
            dbias += g.sum(axis=0)
            dx = (g[:, :, None] * conv.T[None]).reshape(len(w), f, 5, -1)
            for k in range(5):
                np.add.at(de, w[np.arange(len(w))[:, None], a + k], dx[:, :, k])
        return de, dconv, dbias, z.T @ d, np.array([d.sum()], np.float32)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return self._forward(w)[3].astype(float)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))

    def score(self, found) -> np.ndarray:
        """Best calibrated score of each candidate; `found` gives (candidate, window) in order, `BATCH` are held at once."""
        best: list[float] = []
        held: list[tuple[int, np.ndarray]] = []

        def flush():
            p = self.probability(self.logits(np.stack([w for _, w in held])))
            for (k, _), x in zip(held, p.tolist()):
                if k == len(best):
                    best.append(x)
                elif x > best[k]:
                    best[k] = x
            held.clear()

        for pair in found:
            held.append(pair)
            if len(held) == BATCH:
                flush()
        if held:
            flush()
        return np.array(best)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Network from labelled findings in the contexts of some `sample` documents (`SAMPLE_CHARS` of each)."""
    texts = sample_texts(docs, sample, SAMPLE_CHARS)
    if len(texts) < 5:
        return Network(*findings(texts))
    aside = findings(texts[3::5], seed=6, before=_BEFORE + _BEFORE_ASIDE)
    measured = findings(texts[4::5], seed=7, before=_BEFORE_MEASURED)
    return Network(*findings([t for k, t in enumerate(texts) if k % 5 < 3]), aside=aside, measured=measured)


def scan_documents(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans (all of them).

    One row per row, repeated ones too; null and empty texts have none; no rows: no rows. Texts are read whole, and
    windows are scored in batches of bounded size over many texts or one long one. No shuffle.
    """

    def scan(texts: list[str]):
        base = [base_spans(t) for t in texts]
        rest = [(k, s, e) for k, t in enumerate(texts) for cover in [Cover(base[k])] for s, e in candidates(t) if not cover.meets(s, e)]
        p = network.score((n, w) for n, (k, s, e) in enumerate(rest) for w in windows(texts[k], s, e))
        more: list[list[Span]] = [[] for _ in texts]
        for (k, s, e), x in zip(rest, p):
            if x >= network.thresholds[shape(texts[k][s:e])]:
                more[k].append((s, e, "network"))
        return list(zip(base, more))

    needed = np.ones(256, bool)  # 32 letters a to f are hex too, so no byte rules a text out
    return scan_with(docs, scan, BASE, KINDS, needed)
