"""Secret scans: base patterns, and a character convolutional network over every other candidate.

Base findings are fixed patterns. Candidates are what base findings leave of the runs of key characters: pieces of
LEAST or more characters that aren't an ordinary word, that is, that hold a digit beside a letter, or capitals
behind a small letter, or that are LONG or more characters long. Each is scored by the network, which sees the
candidate's characters (in overlapping parts if it is long) and its context on both sides. The network is
numpy only. It learns from labelled findings: base findings of at most TRAIN_DOCS documents, each also with
its keyword masked, and generated keys are positive; those documents' other candidates are negative, but for
those that a first network takes for keys with near certainty, which may be secrets without a label. Scores are
calibrated with Platt's scaling on a held-out third, on one side of which a finding and its masked twin
stand together; the threshold is the highest one that keeps RECALL of its positives.

Edge cases: a null or empty text has no findings; repeated rows are scanned as often as they occur, rows
without an id like any other; an empty table trains on generated keys alone and gives an empty result; lengths
are unbounded.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from refloom.llm.common import mapped_texts, sampled_rows, slices, tidy

TRAIN_DOCS = 2000  #: documents that labelled findings are taken from, at most
NEGATIVES = 6000  #: negative candidates used, at most
GENERATED = 1500  #: generated keys
RECALL = 0.99  #: share of held-out positives that the threshold keeps
DOUBT = 0.97  #: score of a first network from which a candidate isn't used as a negative
LEAST, LONG = 6, 16  #: characters of a candidate, and of one that may be letters alone
KINDS = ("assign", "access", "hex", "model")
LEFT, BODY, RIGHT, STEP = 16, 40, 8, 20
LENGTH = LEFT + BODY + RIGHT
EMBED, WIDTH, FILTERS = 8, 5, 24

# The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
KEYLIKE = re.compile(rf"(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])|(?=[^ ]*[a-z][A-Z])|.{{{LONG}}}")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; offsets in code points, ends exclusive."""
    runs = [m.span() for m in RUN.finditer(text)]  # access keys and long hex runs lie within these
    return _base(text, runs)


def _base(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for a, b in runs:
        if b - a >= 20:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        if b - a >= 24:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base findings, and the candidates: what they leave of each run."""
    runs = [m.span() for m in RUN.finditer(text)]
    base, rest = _base(text, runs), []
    covered = sorted((s, e) for s, _, e in base)
    at = 0
    for a, b in runs:
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        k = at
        while k < len(covered) and covered[k][0] < b:
            if covered[k][0] > a:
                rest.append((a, covered[k][0]))
            a = max(a, covered[k][1])
            k += 1
        rest.append((a, b))
    return base, [(a, b) for a, b in rest if b - a >= LEAST and KEYLIKE.match(text[a:b])]


_CODE = np.zeros(256, dtype=np.int64)
for _c in range(32, 127):
    _CODE[_c] = _c - 30
PAD, OTHER, CHARS = 0, 1, 98


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the parts of a candidate with their context: (parts, LENGTH)."""
    parts = range(start, max(start + 1, end - BODY + STEP), STEP) if end - start > BODY else (start,)
    out = np.zeros((len(parts), LENGTH), dtype=np.int64)
    for k, at in enumerate(parts):
        left, body, right = text[max(0, at - LEFT) : at], text[at : min(end, at + BODY)], text[min(end, at + BODY) : min(end, at + BODY) + RIGHT]
        for where, s in ((LEFT - len(left), left), (LEFT, body), (LEFT + BODY, right)):
            raw = np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)
            out[k, where : where + len(raw)] = np.where(_CODE[raw] > 0, _CODE[raw], OTHER)
    return out


@dataclass
class CharCNN:
    """Embedding, one convolution, maxima over context and body, a linear layer."""

    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 7) -> CharCNN:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (CHARS, EMBED)), r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, 2 * FILTERS), 0.0)

    def _forward(self, x: np.ndarray):
        n = LENGTH - WIDTH + 1
        emb = self.e[x]
        cols = np.stack([emb[:, k : k + n] for k in range(WIDTH)], axis=2).reshape(len(x), n, -1)
        h = np.maximum(cols @ self.w + self.b, 0)
        ctx = np.r_[0 : LEFT - 2, LEFT + BODY - 2 : n]
        body = np.r_[LEFT - 2 : LEFT + BODY - 2]
        a, z = ctx[h[:, ctx].argmax(1)], body[h[:, body].argmax(1)]
        f, rows = np.arange(FILTERS), np.arange(len(x))[:, None]
        pooled = np.concatenate([h[rows, a, f], h[rows, z, f]], axis=1)
        return cols, pooled, a, z, pooled @ self.v + self.c

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[4] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        cols, pooled, a, z, logit = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(x)
        g = {"v": pooled.T @ d, "c": np.array(d.sum())}
        dp = d[:, None] * self.v * (pooled > 0)
        rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)
        dh = np.zeros((len(x), cols.shape[1], FILTERS))
        dh[rows, a, f] += dp[:, :FILTERS]
        dh[rows, z, f] += dp[:, FILTERS:]
        flat = dh.reshape(-1, FILTERS)
        g["w"], g["b"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0)
        dc = (flat @ self.w.T).reshape(len(x), cols.shape[1], WIDTH, EMBED)
        g["e"] = np.zeros_like(self.e)
        for k in range(WIDTH):
            np.add.at(g["e"], x[:, k : k + cols.shape[1]].ravel(), dc[:, :, k].reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> CharCNN:
        r = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        m = {k: [np.zeros_like(np.asarray(getattr(self, k), dtype=float)) for _ in range(2)] for k in "ewbvc"}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                at, t = order[i : i + 64], t + 1
                for k, g in self.step(x[at], y[at], weight[at]).items():
                    m[k][0] = 0.9 * m[k][0] + 0.1 * g
                    m[k][1] = 0.999 * m[k][1] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - rate * (m[k][0] / (1 - 0.9**t)) / (np.sqrt(m[k][1] / (1 - 0.999**t)) + 1e-8))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> CharCNN:
        z, self.scale, self.shift = self.logits(x), 1.0, 0.0
        lo, hi = 1 / ((y == 0).sum() + 2), ((y == 1).sum() + 1) / ((y == 1).sum() + 2)
        goal = np.where(y == 1, hi, lo)
        for _ in range(200):  # Platt's scaling by gradient steps
            d = self.probability(z) - goal
            s = max(1.0, float(np.mean(z * z)))
            self.scale, self.shift = max(0.05, self.scale - float(np.mean(d * z)) / s), self.shift - float(np.mean(d))
        p = np.sort(self.probability(z[y == 1]))
        self.threshold = float(p[int((1 - RECALL) * len(p))]) if len(p) else 0.5
        return self


def generated_key(r: random.Random) -> str:
    alphabet = r.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    return r.choice(("", "", "sk_live_", "ghp_", "xoxb-")) + "".join(r.choice(alphabet) for _ in range(r.randint(10, 44)))


def train(texts: list[str], seed: int = 11) -> CharCNN:
    """Examples are groups of windows: a finding with its masked twin, or one other candidate."""
    r = random.Random(seed)
    pos, neg = [], []
    for t in texts:
        base, rest = scan(t)
        neg += [[windows(t, a, b)[0]] for a, b in rest]
        for s, kind, e in base:
            key = ASSIGN.match(t, s)
            a = key.start(2) if kind == 0 and key else s
            masked = t[max(0, s - 40) : s] + t[a : e + 40]
            pos.append([windows(t, a, e)[0], windows(masked, min(s, 40), min(s, 40) + e - a)[0]])
    r.shuffle(neg)
    neg = neg[:NEGATIVES]
    places = [t for t in texts if len(t) > 40] or ["the key is here and there in the text"]
    for _ in range(GENERATED):
        t, key = r.choice(places), generated_key(r)
        at = r.randrange(len(t))
        at = t.find(" ", at) + 1 or at
        pos.append([windows(t[max(0, at - 20) : at] + key + " " + t[at : at + 20], min(at, 20), min(at, 20) + len(key))[0]])
    for _ in range(max(600, 1200 - len(neg))):  # long words, numbers, and short words with a number are ordinary text
        how = r.random()
        parts = "".join(r.choice(("th", "er", "on", "an", "tion", "ung", "eau", "ble", "ing")) for _ in range(r.randint(6, 9)))
        word = parts if how < 0.4 else "".join(r.choice("0123456789") for _ in range(16)) if how < 0.6 else parts[: r.randint(4, 12)] + r.choice(("", "-", "_")) + str(r.randrange(3000)) if how < 0.8 else parts[:6].capitalize() + parts[6:].capitalize()
        neg.append([windows(f"the {word} and so on", 4, 4 + len(word))[0]])
    held = lambda k: k % 3 == 2
    part = lambda groups, test: [w for k, g in enumerate(groups) if held(k) == test for w in g]

    def fitted(neg):
        p, n = part(pos, False), part(neg, False)
        return CharCNN.fresh().fit(np.array(p + n), np.r_[np.ones(len(p)), np.zeros(len(n))])

    first = fitted(neg)
    sure = first.probability(first.logits(np.array([g[0] for g in neg]))) >= DOUBT
    neg = [g for g, s in zip(neg, sure) if not s]
    p, n = part(pos, True), part(neg, True)
    return fitted(neg).calibrate(np.array(p + n), np.r_[np.ones(len(p)), np.zeros(len(n))])


def score_candidates(model: CharCNN, found: list[tuple[str, int, int]]) -> np.ndarray:
    """The largest probability over the parts of each candidate (text, start, end)."""
    parts = [windows(*c) for c in found]
    if not parts:
        return np.zeros(0)
    p, ends = model.probability(model.logits(np.concatenate(parts))), np.cumsum([len(x) for x in parts])
    return np.maximum.reduceat(p, np.r_[0, ends[:-1]])


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: CharCNN | None = None) -> DataFrame:
    """(doc_id, findings array<struct<kind, start, end, score>>) in order of start and kind; base findings
    have score 1. Candidates of a batch are scored together, in parts of 20,000."""
    picked = docs.selectExpr(f"`{id_col}` AS i", f"`{text}` AS t")
    if model is None:
        model = train([r[0] for r in sampled_rows(picked, "i", TRAIN_DOCS, ["t"]) if r[0]])

    def fill(texts):
        texts = [t or "" for t in texts]
        out, waiting = [], []
        for k, t in enumerate(texts):
            base, rest = scan(t)
            out.append([(s, kind, e, 1.0) for s, kind, e in base])
            waiting += [(k, s, e) for s, e in rest]
        for k, s, e, p in found_by(model, texts, waiting):
            out[k].append((s, 3, e, p))
        return ([[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(f)] for f in out],)

    return mapped_texts(picked, fill, "findings array<struct<kind: string, start: long, end: long, score: double>>", "t", "i")


def found_by(model: CharCNN, texts: list[str], waiting: list[tuple[int, int, int]]):
    """(k, start, end, score) of the candidates (k, start, end) at or above the threshold; they are scored in parts
    of 5,000, so that their windows take little memory."""
    for at in range(0, len(waiting), 5000):
        part = waiting[at : at + 5000]
        for (k, s, e), p in zip(part, score_candidates(model, [(texts[k], s, e) for k, s, e in part])):
            if p >= model.threshold:
                yield k, s, e, float(p)


def span_text(findings: list[dict]) -> str:
    return ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in findings)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, from the findings."""
    from pyspark.sql import functions as F

    one = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    spans = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return find_secrets(docs).select(
        "doc_id", one("assign").alias("n_assign"), one("access").alias("n_access"), one("hex").alias("n_hex"),
        F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"), one("model").alias("n_model"),
    )


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]", model: CharCNN | None = None) -> DataFrame:
    """The same rows and columns, every finding of a text replaced by `mark`; overlapping findings become one.
    The column of character counts, if there is one, follows the text."""
    if model is None:
        key = "doc_id" if "doc_id" in docs.columns else text
        model = train([r[0] for r in sampled_rows(docs, key, TRAIN_DOCS, [text]) if r[0]])
    at, schema = docs.columns.index(text), docs.schema
    counted = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def fill(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, at)):
            texts = b.column(at).to_pylist()
            found, waiting = [], []
            for k, t in enumerate(texts):
                base, rest = scan(t) if t else ([], [])
                found.append([(s, e) for s, _, e in base])
                waiting += [(k, s, e) for s, e in rest]
            for k, s, e, _ in found_by(model, texts, waiting):
                found[k].append((s, e))
            for k, spans in enumerate(found):
                if spans:
                    out, end = [], 0
                    for s, e in sorted(spans):
                        if s >= end:
                            out += [texts[k][end:s], mark]
                        end = max(end, e)
                    texts[k] = "".join([*out, texts[k][end:]])
            cols = list(b.columns)
            cols[at] = pa.array(texts, type=cols[at].type)
            if counted is not None:
                old = cols[counted].to_pylist()
                cols[counted] = pa.array([len(t) if t is not None and f else o for t, f, o in zip(texts, found, old)], type=cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
        tidy()

    return docs.mapInArrow(fill, schema)
