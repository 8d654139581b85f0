"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows.

A word enters as its own embedding beside the summed embeddings of its character trigrams and beginnings,
over the root of their number (all hashed). Two
gated recurrent passes read a window of WINDOW words, attention pools their states, and a linear layer
gives the window's logit. All windows, HOP words apart, of the whole text are scored; the largest logit is
the text's, calibrated with Platt's scaling on documents that the weights weren't fitted on. Inputs times
input weights are worked out once for a word form.

Training is numpy only, on at most TRAIN_EACH documents of either label: first with windows, at most TRAIN_WINDOWS
of either label in an epoch, under their documents' labels, then with the window of each document that scores
highest.

Edge cases: rows without an id and repeated rows are scored like any other; a null or empty text, or one of white space only, has no window and score 0; with fewer than
two labels in the training rows every score is the share of label 1; lengths are unbounded.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import WordTable, mapped_texts, sampled_rows, train_fold

TRAIN_EACH = 500  #: labelled documents of either label used for fitting, at most
WINDOW, HOP = 24, 12
SLOTS, EMBED, HIDDEN = 16384, 6, 8
MEMO_WORDS = 250_000  #: word forms whose inputs a task keeps
TRAIN_WINDOWS = 1500  #: windows of either label in an epoch of the first kind, at most
THRESHOLD = 0.7
FEW = 3  #: documents that a hashed word or trigram must be in to have an embedding


def slots(word: str) -> tuple[int, list[int]]:
    w = word.lower().strip(".,;:!?|()[]\"'").encode()
    p = b"^" + w + b"$"
    grams = [p[i : i + 3] for i in range(max(1, len(p) - 2))] + [p[:n] for n in (4, 5, 6, 7) if len(p) > n]
    return zlib.crc32(w, 1) % SLOTS, [zlib.crc32(g, 2) % SLOTS for g in grams]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGRU:
    def __init__(self, seed: int = 4):
        r, d, h = np.random.default_rng(seed), 2 * EMBED, HIDDEN
        n = lambda *s, scale: r.normal(0, scale, s)
        self.p = {
            "word": n(SLOTS, EMBED, scale=0.1), "char": n(SLOTS, EMBED, scale=0.1),
            "w0": n(d, 3 * h, scale=0.3), "u0": n(h, 3 * h, scale=0.3), "b0": np.zeros(3 * h),
            "w1": n(d, 3 * h, scale=0.3), "u1": n(h, 3 * h, scale=0.3), "b1": np.zeros(3 * h),
            "a": n(2 * h, h, scale=0.3), "v": n(h, scale=0.3), "o": n(2 * h, scale=0.3), "c": np.zeros(1),
        }
        self.seen: dict[str, np.ndarray] = {}
        self.scale, self.shift, self.constant = 1.0, 0.0, None
        self.table: WordTable | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None, "p": {k: v.astype(np.float32) for k, v in self.p.items()}}

    # inputs of words

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        got = [slots(w) for w in words]
        word, sizes = np.array([g[0] for g in got]), np.array([len(g[1]) for g in got])
        char = np.concatenate([g[1] for g in got]).astype(np.int64)
        mean = np.add.reduceat(self.p["char"][char], np.r_[0, np.cumsum(sizes)[:-1]]) / np.sqrt(sizes)[:, None]
        return np.concatenate([self.p["word"][word], mean], axis=1), (word, char, sizes)

    def inputs(self, words: list[str]) -> np.ndarray:
        x = self.embed(words)[0]
        return np.concatenate([x @ self.p["w0"] + self.p["b0"], x @ self.p["w1"] + self.p["b1"]], axis=1)

    # windows: xw (n, WINDOW, 6 h), sizes (n,)

    def run(self, xw: np.ndarray, sizes: np.ndarray, keep: bool = False):
        n, h, p = len(xw), HIDDEN, self.p
        live = np.arange(WINDOW) < sizes[:, None]
        states, tape = np.zeros((n, WINDOW, 2 * h), dtype=xw.dtype), ([], [])
        for way in (0, 1):
            u, s = p[f"u{way}"], np.zeros((n, h), dtype=xw.dtype)
            for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
                x, y = xw[:, t, way * 3 * h : (way + 1) * 3 * h], s @ u
                g = 1 / (1 + np.exp(-(x[:, : 2 * h] + y[:, : 2 * h])))
                z, r = g[:, :h], g[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                new = np.where(live[:, t, None], c + z * (s - c), s)
                if keep:
                    tape[way].append((t, s, z, r, c, y[:, 2 * h :]))
                s = new
                states[:, t, way * h : (way + 1) * h] = s
        k = np.tanh(states @ p["a"])
        e = np.where(live, k @ p["v"], -1e9)
        alpha = np.exp(e - e.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", alpha, states)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (live, states, tape, k, alpha, pooled)) if keep else logit

    def gradients(self, xw, sizes, x, y, weight):
        """Of the weighted mean cross-entropy; x: embeddings (n, WINDOW, 2 EMBED). Returns (parameters', x's)."""
        p, h = self.p, HIDDEN
        logit, (live, states, tape, k, alpha, pooled) = self.run(xw, sizes, keep=True)
        d = (_sigmoid(logit) - y) * weight / len(y)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()])}
        dp = d[:, None] * p["o"]
        ds = alpha[:, :, None] * dp[:, None, :]
        da = np.einsum("ntk,nk->nt", states, dp)
        de = alpha * (da - (alpha * da).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nth->h", de, k)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["a"] = np.einsum("ntk,nth->kh", states, dk)
        ds = (ds + dk @ p["a"].T) * live[:, :, None]
        dx = np.zeros_like(x)
        for way in (0, 1):
            u, w, back = p[f"u{way}"], p[f"w{way}"], np.zeros((len(y), h))
            g[f"u{way}"], g[f"w{way}"], g[f"b{way}"] = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h)
            for t, s, z, r, c, yc in reversed(tape[way]):
                full = back + ds[:, t, way * h : (way + 1) * h]
                dn = full * live[:, t, None]
                dz, dc = dn * (s - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * yc * r * (1 - r)
                dy, dxw = np.concatenate([dz, dr, dc * r], axis=1), np.concatenate([dz, dr, dc], axis=1)
                g[f"u{way}"] += s.T @ dy
                g[f"w{way}"] += x[:, t].T @ dxw
                g[f"b{way}"] += dxw.sum(0)
                dx[:, t] += dxw @ w.T
                back = np.where(live[:, t, None], dn * z + dy @ u.T, full)
        return g, dx

    # training

    def fit(self, docs: list[tuple[list[str], int]], epochs: tuple[int, int] = (2, 3), rate: float = 0.01, seed: int = 2) -> BiGRU:
        r = np.random.default_rng(seed)
        forms = list(dict.fromkeys(w for words, _ in docs for w in words))
        at = {w: i for i, w in enumerate(forms)}
        got = [slots(w) for w in forms]
        word, sizes = np.array([g[0] for g in got]), np.array([len(g[1]) for g in got])
        char, begins = np.concatenate([g[1] for g in got]).astype(np.int64), np.r_[0, np.cumsum([len(g[1]) for g in got])[:-1]]
        win, size, own, label = [], [], [], []
        for d, (words, y) in enumerate(docs):
            ids = [at[w] for w in words]
            for s in starts(len(ids)):
                part = ids[s : s + WINDOW]
                win.append(part + [0] * (WINDOW - len(part)))
                size.append(len(part))
                own.append(d)
                label.append(y)
        win, size, own, label = np.array(win), np.array(size), np.array(own), np.array(label, dtype=float)
        self.seed(docs, at, word, char, begins, sizes)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0

        def chars(ids):  # the characters' slots of the words one after another, and where each begins
            n = sizes[ids]
            first = np.r_[0, np.cumsum(n)[:-1]]
            return char[np.repeat(begins[ids] - first, n) + np.arange(n.sum())], first, n

        def update(pick):
            nonlocal step
            step += 1
            ids, inv = np.unique(win[pick], return_inverse=True)
            spelt, first, n = chars(ids)
            mean = np.add.reduceat(self.p["char"][spelt], first) / np.sqrt(n)[:, None]
            x = np.concatenate([self.p["word"][word[ids]], mean], axis=1)[inv.reshape(len(pick), WINDOW)]
            xw = np.concatenate([x @ self.p["w0"] + self.p["b0"], x @ self.p["w1"] + self.p["b1"]], axis=2)
            y = label[pick]
            weight = np.where(y == 1, 0.5 / max(y.mean(), 0.1), 0.5 / max(1 - y.mean(), 0.1))
            g, dx = self.gradients(xw, size[pick], x, y, weight)
            flat = np.zeros((len(ids), 2 * EMBED))
            np.add.at(flat, inv.ravel(), (dx * (np.arange(WINDOW) < size[pick][:, None])[:, :, None]).reshape(-1, 2 * EMBED))
            g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
            np.add.at(g["word"], word[ids], flat[:, :EMBED])
            np.add.at(g["char"], spelt, np.repeat(flat[:, EMBED:] / np.sqrt(n)[:, None], n, axis=0))
            for k, v in g.items():
                v = v * self.seen[k] if k in self.seen else v
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * v
                m[1] = 0.999 * m[1] + 0.001 * v * v
                self.p[k] = self.p[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

        for epoch in range(sum(epochs)):
            if epoch < epochs[0]:  # as many windows of either label
                few = min(TRAIN_WINDOWS, int((label == 1).sum()), int((label == 0).sum()))
                pick = np.concatenate([r.permutation(np.flatnonzero(label == y))[:few] for y in (0, 1)])
            else:
                logit = self.logits_of(docs)
                order = np.lexsort((-logit, own))
                top = order[np.r_[True, own[order][1:] != own[order][:-1]]]
                more = r.permutation(np.flatnonzero(label == 0))[: len(top)]
                pick = np.concatenate([top, more])
            for _ in range(max(1, -(-20 // -(-len(pick) // 64)))):  # at least 20 steps, however few the rows
                mixed = r.permutation(pick)
                for i in range(0, len(mixed), 64):
                    update(mixed[i : i + 64])
        return self

    def seed(self, docs, at, word, char, begins, sizes) -> None:
        """Embeddings of slots that fewer than FEW training documents have are 0 and stay 0; the first
        number of the others starts as the slot's z-score between the labels, over 4."""
        y = np.array([y for _, y in docs], dtype=float)
        n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
        for name in ("word", "char"):
            df = np.zeros((2, SLOTS))
            for words, label in docs:
                ids = np.unique([at[w] for w in words])
                own = word[ids] if name == "word" else np.concatenate([char[begins[i] : begins[i] + sizes[i]] for i in ids])
                df[label, np.unique(own)] += 1
            share = df.sum(0) / (n0 + n1)
            z = (df[1] / n1 - df[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-6)
            self.seen[name] = (df.sum(0) >= FEW).astype(np.float32)[:, None]
            self.p[name] = self.p[name] * self.seen[name]
            self.p[name][:, 0] = np.clip(z, -12, 12) / 4 * self.seen[name][:, 0]

    def logits_of(self, docs: list[tuple[list[str], int]]) -> np.ndarray:
        """Of all windows of the documents, in order."""
        self.table = None
        return np.concatenate([self.window_logits([w for w, _ in docs[i : i + 200]])[0] for i in range(0, len(docs), 200)])

    def calibrate(self, docs: list[tuple[list[str], int]]) -> BiGRU:
        y = np.array([y for _, y in docs])
        z = np.array([self.top([w])[0] for w, _ in docs])
        lo, hi = 1 / ((y == 0).sum() + 2), ((y == 1).sum() + 1) / ((y == 1).sum() + 2)
        goal, spread = np.where(y == 1, hi, lo), max(1.0, float(np.mean(z * z)))
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(500):
            d = (_sigmoid(self.scale * z + self.shift) - goal) * weight
            self.scale, self.shift = max(0.05, self.scale - float(np.mean(d * z)) / spread), self.shift - float(np.mean(d))
        return self

    # scoring

    def window_logits(self, texts: list[list[str]]) -> tuple[np.ndarray, list[int]]:
        """Logits of all windows of texts with at least one word, and the number of each text's windows."""
        words = [w for t in texts for w in t]
        if self.table is None:
            self.table = WordTable(6 * HIDDEN, self.inputs, MEMO_WORDS)
        x = self.table.look(words)
        begins, sizes, counts, base = [], [], [], 0
        for t in texts:
            s = starts(len(t))
            counts.append(len(s))
            begins += [base + i for i in s]
            sizes += [min(WINDOW, len(t) - i) for i in s]
            base += len(t)
        begins, sizes = np.array(begins), np.array(sizes)
        out = []
        for i in range(0, len(begins), 4096):
            at = np.minimum(begins[i : i + 4096, None] + np.arange(WINDOW), len(words) - 1)
            out.append(self.run(x[at], sizes[i : i + 4096]))
        return np.concatenate(out), counts

    def top(self, texts: list[list[str]]) -> np.ndarray:
        logit, counts = self.window_logits(texts)
        return np.maximum.reduceat(logit, np.r_[0, np.cumsum(counts)[:-1]])

    def scores(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1 for each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        words, out = [t.split() for t in texts], np.zeros(len(texts))
        full = [i for i, w in enumerate(words) if w]
        if full:
            out[full] = _sigmoid(self.scale * self.top([words[i] for i in full]).astype(float) + self.shift)
        return out


def starts(n: int) -> range:
    """Of the windows over n words: HOP apart, the last one reaching the end."""
    return range(0, max(1, n - WINDOW + HOP), HOP)


def train(rows: list[tuple[str, int]]) -> BiGRU:
    docs = [(t.split(), int(y)) for t, y in rows if t and t.split()]
    model = BiGRU()
    if len({y for _, y in docs}) < 2 or len(docs) < 6:
        model.constant = float(np.mean([y for _, y in docs])) if docs else 0.0
        return model
    held = [k % 4 == 3 for k in range(len(docs))]
    model.fit([d for d, h in zip(docs, held) if not h])
    model.table = None
    return model.calibrate([d for d, h in zip(docs, held) if h])


def fit_from(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> BiGRU:
    """Fits on at most `each` documents of either label, of the training folds."""
    marks = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(train_fold(F.col("doc_id")))
    may = docs.select("doc_id", "text").where("text IS NOT NULL")
    rows = []
    for y in (0, 1):
        ids = marks.where(F.col("toxic") == y).select("doc_id")
        rows += [(r[1], y) for r in sampled_rows(may, "doc_id", each, ["doc_id", "text"], ids)]
    rows.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[1]))
    return train(rows)


def toxicity(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", id_col: str = "doc_id", model: BiGRU | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    model = model if model is not None else fit_from(docs, labels)

    def fill(texts):
        texts = [t or "" for t in texts]
        score, at, total = np.zeros(len(texts)), 0, 0
        for i, t in enumerate(texts):
            total += len(t)
            if total > 1_500_000 or i + 1 == len(texts):
                score[at : i + 1] = model.scores(texts[at : i + 1])
                at, total = i + 1, 0
        return score, (score >= THRESHOLD).astype("int32")

    return mapped_texts(docs, fill, "score double, predicted int", text, id_col)
