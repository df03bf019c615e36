"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

A candidate is a run of key-like characters, or what the patterns leave of one, 16 at least. The network reads the whole
candidate and its surroundings. It is trained in numpy on labelled findings (made from a seed: keys of many
forms, and things that look like keys and are none), its scores are calibrated on findings held out from
training, and the threshold of each form is the highest that keeps a given recall there. What it accepts is
added to the pattern's spans; those always stay.

Rows: a null text counts as empty and has no spans. Rows stand for themselves, so repeated rows give repeated
results; an empty table gives none. ``doc_id`` may be null. Other columns are ignored by ``scan`` and kept by
``redact``. Places are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@:-]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "api")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if any(len(w) >= 24 and _HEX.search(w) for w in text.split()):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans leave of key-like runs, without the signs that part it from them: 16 characters at least."""
    if not any(len(w) >= 16 for w in text.split()):
        return []
    taken = sorted((a, b) for _, a, b in spans)
    out = []
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        for a, b in [*(x for x in taken if x[0] < end and x[1] > at), (end, end)]:
            if a - at >= 16:
                out.append((at, a))
            at = max(at, b)
            while b < end and at < end and text[at] in ":@=":
                at += 1
    return out


# --- labelled findings ---------------------------------------------------------------------------------

_SYLLABLES = ("an er in on th re st en at or ti es nd to it is ar te al he ou le se me de ve co ra ro li ha ne ma lo ca di".split())
_CLUSTERS = "sch ung keit lich zu be ver ge tz pf cht str ich ein heit schaft zeug ght ough ness tion ment eux".split()


class _Maker:
    """Findings from a seed: (left, candidate, right, label)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def chars(self, alphabet: str, a: int, b: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(a, b)))

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def long_word(self) -> str:
        """Letters alone, 16 at least, as in compounds."""
        out = ""
        while len(out) < 16:
            out += self.r.choice(_SYLLABLES + 2 * _CLUSTERS)
        return self.r.choice((out, out, out.capitalize(), out.upper()))

    def near(self) -> str:
        """A word of the surroundings: of syllables or of any letters, some with a sign behind."""
        r = self.r
        own = self.word() if r.random() < 0.5 else self.chars(string.ascii_lowercase + "éèçñüöäßóí", 1, 14)
        return (own.capitalize() if r.random() < 0.15 else own) + (r.choice(",.;:") if r.random() < 0.2 else "")

    def words(self, n: int) -> str:
        return self.r.choice(("", "\n")) + " ".join(self.near() for _ in range(n))

    def secret(self) -> str:
        alnum, c = string.ascii_letters + string.digits, self.chars
        return self.r.choice((
            lambda: c(alnum, 20, 64),
            lambda: c(alnum + "+/", 38, 88) + "=" * self.r.randint(0, 2),
            lambda: "ghp_" + c(alnum, 36, 36),
            lambda: self.r.choice(("sk-", "sk_live_", "pk_test_", "rk_live_")) + c(alnum, 24, 48),
            lambda: f"xoxb-{c(string.digits, 11, 12)}-{c(alnum, 24, 24)}",
            lambda: f"eyJ{c(alnum, 15, 30)}.eyJ{c(alnum, 20, 60)}.{c(alnum + '_-', 43, 43)}",
            lambda: "AIza" + c(alnum + "_-", 35, 35),
            lambda: c(string.hexdigits.upper(), 32, 64),
            lambda: c(string.ascii_lowercase + string.digits, 24, 40),
            lambda: "glpat-" + c(alnum + "_-", 20, 20),
            lambda: c(3 * string.digits + "ABCDEF", 24, 48),
            lambda: f"{c(string.digits, 12, 20)}:{c(string.digits, 8, 16)}",
            lambda: "-".join(c(string.digits, 8, 8) for _ in range(self.r.randint(3, 5))),
        ))()

    def other(self) -> str:
        w, d, r = self.word, lambda a, b: self.chars(string.digits, a, b), self.r
        return r.choice((
            lambda: f"{w()}.{d(2, 2)}@{w()}{d(1, 1)}.{r.choice(('com', 'org', 'example.com'))}",
            lambda: d(16, 19),
            lambda: ".".join(str(r.randint(100, 255)) for _ in range(4)) + ":" + d(2, 5),
            lambda: f"https://www.{w()}{w()}.com/{w()}/{d(2, 4)}/{w()}-{w()}.html",
            lambda: f"20{d(2, 2)}-0{r.randint(1, 9)}-1{d(1, 1)}T1{d(1, 1)}:2{d(1, 1)}:3{d(1, 1)}.{d(3, 6)}Z",
            lambda: "-".join(w() for _ in range(r.randint(3, 6))) + "-" + d(1, 3),
            lambda: f"/{w()}/{w()}/{w()}_{w()}{d(1, 2)}.{r.choice(('py', 'txt', 'json'))}",
            lambda: "".join(w() for _ in range(4)) + d(1, 2),
            lambda: r.choice("=-.") * r.randint(12, 30) + d(1, 2),
            lambda: f"{w()}.{w()}.{w()}{d(1, 1)}.{w()}.{w()}",
            lambda: f"{d(3, 3)}-{d(3, 3)}-{d(4, 4)}-{d(4, 6)}",
            lambda: f"v{d(1, 1)}.{d(1, 2)}.{d(1, 2)}-{w()}.{w()}.{d(1, 3)}",
            lambda: f"{w().capitalize()}{w().capitalize()}{w().capitalize()}{w().capitalize()}{d(1, 2)}",
            lambda: r.choice(("", "-", "_", ".", "/")).join(w() for _ in range(r.randint(4, 7))),
            lambda: "".join(w().capitalize() for _ in range(r.randint(4, 6))),
            self.long_word,
            self.long_word,
            lambda: f"{w()}.{w()}@{w()}.{r.choice(('com', 'org', 'example.com'))}",
            lambda: f"https://www.{w()}{w()}.com/{w()}/{w()}-{w()}.html",
            lambda: r.choice("=-.") * r.randint(16, 60),
        ))()

    def finding(self) -> tuple[str, str, str, int]:
        label = self.r.randint(0, 1)
        body = self.secret() if label else self.other()
        while len(body) < 16:
            body += self.word() if not label else "x7Q"
        hint = self.r.choice(("key: ", "credential ", "Authorization: Bearer ", "auth=", 'client "')) if self.r.random() < 0.25 else ""
        return f"{self.words(self.r.randint(0, 5))} {hint}"[-24:], body, f" {self.words(self.r.randint(0, 4))}"[:12], label


# --- network --------------------------------------------------------------------------------------------

LEFT, RIGHT, WIDTH, DIM, FILTERS = 24, 12, 5, 8, 16
_CHARS = np.zeros(128, dtype=np.int64)
for _i in range(32, 127):
    _CHARS[_i] = _i - 30  # 0: padding, 1: anything else
CLASSES = 97
FORMS = ("digits", "upper", "other")


def form_of(body: str) -> int:
    """Forms have thresholds of their own: mostly digits, with capitals, the rest."""
    digits = sum(c.isdigit() for c in body)
    return 0 if 10 * digits >= 7 * len(body) else 1 if any(c.isupper() for c in body) else 2


def _encode(findings: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes, padded to the longest, and which characters are inside the candidate."""
    size = max(len(a) + len(b) + len(c) for a, b, c in findings) + WIDTH - 1
    codes, inside = np.zeros((len(findings), size), dtype=np.int64), np.zeros((len(findings), size), dtype=np.float32)
    for i, (a, b, c) in enumerate(findings):
        raw = np.frombuffer((a + b + c).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes[i, :len(raw)] = np.where(raw < 128, _CHARS[np.minimum(raw, 127)], 1)
        codes[i, :len(raw)][codes[i, :len(raw)] == 0] = 1
        inside[i, len(a):len(a) + len(b)] = 1
    return codes, inside


def _forward(p: dict[str, np.ndarray], codes: np.ndarray, inside: np.ndarray):
    x = np.concatenate([p["emb"][codes], inside[:, :, None]], axis=2)
    n, size, dim = x.shape
    out = size - WIDTH + 1
    cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, out, WIDTH * dim)
    z = cols @ p["conv"] + p["bias"]
    a = np.maximum(z, 0)
    top = a.argmax(axis=1)
    mask = inside[:, WIDTH // 2:WIDTH // 2 + out, None]
    share = mask / np.maximum(mask.sum(axis=1, keepdims=True), 1)
    pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], (a * share).sum(axis=1)], axis=1)
    return pooled @ p["out"] + p["last"][0], (cols, z, top, share, pooled)


def _gradients(p, codes, inside, labels):
    logits, (cols, z, top, share, pooled) = _forward(p, codes, inside)
    err = (1 / (1 + np.exp(-logits)) - labels) / len(labels)
    back = err[:, None] * p["out"][None, :]
    n, out, f = z.shape
    da = share * back[:, None, f:]
    np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + back[:, None, :f], 1)
    dz = da * (z > 0)
    flat = dz.reshape(-1, f)
    dx = (flat @ p["conv"].T).reshape(n, out, WIDTH, -1)
    emb = np.zeros_like(p["emb"])
    for k in range(WIDTH):
        np.add.at(emb, codes[:, k:k + out].ravel(), dx[:, :, k, :DIM].reshape(-1, DIM))
    return {"emb": emb, "conv": cols.reshape(-1, cols.shape[2]).T @ flat, "bias": flat.sum(axis=0), "out": pooled.T @ err, "last": err.sum(keepdims=True)}


@dataclass(frozen=True)
class Scanner:
    """Weights, calibration (slope, offset) and the threshold of each form."""

    weights: dict[str, np.ndarray]
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def scores(self, findings: list[tuple[str, str, str]], cells: int = 1 << 18) -> np.ndarray:
        """Calibrated probabilities. Findings of like length are scored together, in bounded memory."""
        out = np.zeros(len(findings))
        order = sorted(range(len(findings)), key=lambda i: len(findings[i][1]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * (len(findings[order[at + n]][1]) + 64) <= cells // 16:
                n += 1
            own = order[at:at + n]
            logits, _ = _forward(self.weights, *_encode([findings[i] for i in own]))
            out[own] = 1 / (1 + np.exp(-(self.slope * logits + self.offset)))
            at += n
        return out

    def learned_spans(self, text: str, spans: list[Span]) -> list[Span]:
        found = candidates(text, spans)
        if not found:
            return []
        views = [(text[max(0, a - LEFT):a], text[a:b], text[b:b + RIGHT]) for a, b in found]
        return [
            ("learned", a, b) for (a, b), view, score in zip(found, views, self.scores(views))
            if score >= self.thresholds[form_of(view[1])]
        ]


@cache
def train(seed: int = 7, examples: int = 8000, epochs: int = 6, recall: float = 0.98) -> Scanner:
    """Trains on ``examples`` labelled findings, calibrates on a fourth as many others, and sets thresholds."""
    maker, rng = _Maker(seed), np.random.default_rng(seed)
    data = [maker.finding() for _ in range(examples)]
    held = [maker.finding() for _ in range(examples // 4)]
    f32 = np.float32
    p = {
        "emb": rng.normal(0, 0.3, (CLASSES, DIM)).astype(f32), "conv": rng.normal(0, 0.15, (WIDTH * (DIM + 1), FILTERS)).astype(f32),
        "bias": np.zeros(FILTERS, f32), "out": rng.normal(0, 0.2, 2 * FILTERS).astype(f32), "last": np.zeros(1, f32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 24)
        groups = [order[i:i + 64] for i in range(0, len(order), 64)]
        for g in rng.permutation(len(groups)).tolist():
            rows = [data[i] for i in groups[g]]
            grads = _gradients(p, *_encode([x[:3] for x in rows]), np.array([x[3] for x in rows], f32))
            step += 1
            for k, grad in grads.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p[k] = (p[k] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(f32)
    raw = Scanner(p, 1.0, 0.0, (0.5,) * len(FORMS)).scores([x[:3] for x in held])
    logits, y = np.log(np.clip(raw, 1e-9, 1 - 1e-9) / np.clip(1 - raw, 1e-9, 1)), np.array([x[3] for x in held], float)
    slope, offset = 1.0, 0.0
    for _ in range(300):  # Platt scaling with smoothed targets
        q = 1 / (1 + np.exp(-(slope * logits + offset)))
        err = q - (y * 0.98 + 0.01)
        slope, offset = slope - 0.05 * float((err * logits).mean() / (logits.var() + 1)), offset - 0.5 * float(err.mean())
    scores = 1 / (1 + np.exp(-(slope * logits + offset)))
    forms = np.array([form_of(x[1]) for x in held])
    limits = []
    for k in range(len(FORMS)):
        own = (forms == k) & (y == 1)
        # the highest threshold at which this share is still found; without a key of a form, that of all keys
        true = np.sort(scores[own if own.any() else y == 1])
        limits.append(float(true[int((1 - recall) * len(true))]))
    return Scanner(p, slope, offset, tuple(limits))


def all_spans(text: str, scanner: Scanner) -> tuple[list[Span], list[Span]]:
    """The spans of the patterns, and those with the network's."""
    base = base_spans(text)
    return base, in_order(base + scanner.learned_spans(text, base))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans: counts and spans (joined) of each document."""
    model = scanner or train()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for text in batch.column(1).to_pylist():
                base, both = all_spans(text or "", model)
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in KINDS[:3]])
                spans.append((joined(base), joined(both)))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            texts = [pa.array([s[k] for s in spans], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *texts], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, scanner: Scanner | None = None, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; all rows and columns stay."""
    model = scanner or train()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is not None:
                _, spans = all_spans(t, model)
                parts, at = [], 0
                for _, a, b in spans:
                    if b > at:
                        parts += [t[at:a], mark] if a >= at else []
                        at = b
                t = "".join([*parts, t[at:]]) if spans else t
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
