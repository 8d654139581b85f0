"""Language ID: a linear-chain conditional random field labels the words of code-switched text.

Every word has a label. Its score for a label is a sum over hashed features: the word itself (lexicon),
its prefixes and suffixes, its character n-grams, and its shape; transitions between labels are learned
too. Training maximises the conditional log-likelihood by gradient steps, with forward-backward for the
expectations, on passages of at most TRAIN_DOCS labelled documents; half of the passages are spliced from
two languages, so that transitions are learned where languages change. A document's scores are the means
of its words' posterior probabilities, weighted by letters.

Forward-backward is exact on whole texts: a text is cut into blocks of BLOCK words, all blocks of a batch
advance together, and the messages between blocks are carried by the blocks' transfer matrices.

Words end at white space; longer ones than LONGEST characters, as in scripts without spaces, are cut into words
of that length, so memory is bounded by a batch of texts whatever their words are.

Edge cases: a null text, or one without any letter, is `und` with score 0; words without letters carry no
evidence of their own; without training rows every text is `und`; ties take the first label in order; rows
without an id and repeated rows are predicted like any other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import WordTable, mapped_texts, sampled_rows, slices, tidy, train_fold

TRAIN_DOCS = 1500  #: labelled documents used for fitting, at most
TRAIN_WORDS = 48_000  #: words of them used, at most
HASH = 1 << 16  #: feature slots
BLOCK = 32  #: words of a block
MEMO_WORDS = 400_000  #: word forms whose scores a task keeps
LONGEST = 48  #: characters of a word
CLIP = 12.0
UND = "und"
WORD = re.compile(rf"\S{{1,{LONGEST}}}")
LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[str]:
    words = text.split()
    return words if max(map(len, words), default=0) <= LONGEST else WORD.findall(text)


def features(word: str) -> list[int]:
    """Slots of a word's features: lexicon entry, shape, affixes of 1 to 4 bytes, n-grams of 2 to 4 bytes
    with borders. The kind of a feature is the start value of its hash."""
    w = word.lower().strip(".,;:!?|()[]\"'").encode()
    padded, crc, m = b"^" + w + b"$", zlib.crc32, HASH - 1
    out = [crc(w, 1) & m, (2 if word[:1].isupper() else 3)]
    for n in (1, 2, 3, 4):
        out += (crc(w[:n], 10 + n) & m, crc(w[-n:], 20 + n) & m)
    for n in (2, 3, 4):
        out += [crc(padded[i : i + n], 30 + n) & m for i in range(len(padded) - n + 1)]
    return out


def letters(word: str) -> int:
    return sum(c.isalpha() for c in word)


class Field:
    """Weights (HASH, labels), transitions (labels, labels), first-word scores (labels)."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.w = labels, np.zeros((HASH, k))
        self.t, self.first = np.eye(k) * 2.0, np.zeros(k)
        self.table: WordTable | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None, "w": self.w.astype(np.float32)}

    def emission(self, words: list[str]) -> np.ndarray:
        """Scores by label and the number of letters of each word."""
        out = np.zeros((len(words), len(self.labels) + 1), dtype=np.float32)
        if words:
            f = [features(w) for w in words]
            sizes = np.array([len(x) for x in f])
            sums = np.add.reduceat(self.w[np.fromiter(chain.from_iterable(f), dtype=np.int64, count=int(sizes.sum()))], np.r_[0, np.cumsum(sizes)[:-1]])
            out[:, -1] = [letters(w) for w in words]
            out[:, :-1] = sums / np.sqrt(sizes)[:, None] * (out[:, -1:] > 0)
        return out

    def look(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = WordTable(len(self.labels) + 1, self.emission, MEMO_WORDS)
        return self.table.look(words)

    def fit(self, passages: list[tuple[list[str], np.ndarray]], epochs: int = 3, rate: float = 0.15, l2: float = 1e-6) -> Field:
        """Adaptive gradient ascent; a passage is (words, labels)."""
        k = len(self.labels)
        gw, gt, gf = np.full_like(self.w, 1e-3), np.full((k, k), 1e-1), np.full(k, 1e-1)
        slots: dict[str, np.ndarray] = {}
        r = np.random.default_rng(5)
        for _ in range(epochs):
            for at in r.permutation(len(passages)):
                words, y = passages[at]
                f = [slots.setdefault(x, np.array(features(x) if LETTER.search(x) else [], dtype=np.int64)) for x in words]
                e = np.array([self.w[s].sum(0) / max(1, len(s)) ** 0.5 for s in f])
                post, pair = self.posterior(e)
                d = -post
                d[np.arange(len(y)), y] += 1
                dt = -pair
                np.add.at(dt, (y[:-1], y[1:]), 1)
                gt += dt * dt
                self.t += rate * dt / np.sqrt(gt)
                gf += d[0] ** 2
                self.first += rate * d[0] / np.sqrt(gf)
                sizes = np.array([len(s) for s in f])
                flat = np.concatenate(f)
                g = np.repeat(d / np.maximum(1, sizes)[:, None] ** 0.5, sizes, axis=0)
                u, inv = np.unique(flat, return_inverse=True)
                s = np.zeros((len(u), k))
                np.add.at(s, inv, g)
                s -= l2 * self.w[u]
                gw[u] += s * s
                self.w[u] += rate * s / np.sqrt(gw[u])
        return self

    def posterior(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain forward-backward of one sequence: (posteriors, expected transitions)."""
        n, k = e.shape
        t, x = np.exp(self.t), np.exp(e - e.max(1, keepdims=True))
        a, b = np.empty((n, k)), np.ones((n, k))
        a[0] = np.exp(self.first - self.first.max()) * x[0]
        a[0] /= a[0].sum()
        for i in range(1, n):
            v = (a[i - 1] @ t) * x[i]
            a[i] = v / v.sum()
        for i in range(n - 2, -1, -1):
            v = t @ (b[i + 1] * x[i + 1])
            b[i] = v / v.sum()
        post = a * b
        post /= post.sum(1, keepdims=True)
        if n < 2:
            return post, np.zeros((k, k))
        pair = a[:-1, :, None] * t * (x[1:] * b[1:])[:, None, :]
        return post, (pair / pair.sum((1, 2), keepdims=True)).sum(0)

    def posteriors(self, e: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Posteriors of the words of many sequences, one after another in e, by blocks; exact."""
        k = len(self.labels)
        t, block = np.exp(self.t - self.t.max()), BLOCK
        per = [-(-n // block) for n in sizes]
        total = sum(per)
        x = np.ones((total * block, k))
        live = np.zeros(total * block, dtype=bool)
        where = np.concatenate([np.arange(n) + b * block for n, b in zip(sizes, np.r_[0, np.cumsum(per)[:-1]].tolist())]).astype(np.int64)
        x[where] = np.exp(np.maximum(e - e.max(1, keepdims=True), -CLIP))
        live[where] = True
        x, live = x.reshape(total, block, k), live.reshape(total, block)
        dead = [np.flatnonzero(~live[:, i]) for i in range(block)]  # behind a sequence's last word
        # a sequence's first word has a prior: there, whatever came before, the transition leads to it
        prior = np.exp(self.first - self.first.max())
        into = np.broadcast_to(t, (total, k, k)).copy()
        into[np.r_[0, np.cumsum(per)[:-1]].astype(np.int64)] = prior
        # transfer matrices of the blocks, from the state before a block to the state at its end
        m = into * x[:, 0, None, :]
        for i in range(1, block):
            n = (m.reshape(-1, k) @ t).reshape(total, k, k) * x[:, i, None, :]
            n[dead[i]] = m[dead[i]]
            m = n / n.sum((1, 2), keepdims=True) if i % 8 == 7 else n
        enter, leave = np.empty((total, k)), np.empty((total, k))
        at = 0
        for n in per:
            v = np.full(k, 1 / k)
            for j in range(at, at + n):
                enter[j] = v
                v = v @ m[j]
                v = v / v.sum()
            v = np.ones(k)
            for j in range(at + n - 1, at - 1, -1):
                leave[j] = v
                v = m[j] @ v
                v = v / np.abs(v).sum()
            at += n
        a, v = np.empty_like(x), enter
        for i in range(block):
            w = (np.einsum("nj,njk->nk", v, into) if i == 0 else v @ t) * x[:, i]
            w[dead[i]] = v[dead[i]]
            v = a[:, i] = w / w.sum(1, keepdims=True)
        b, v = np.empty_like(x), leave
        for i in range(block - 1, -1, -1):
            b[:, i] = v
            w = (v * x[:, i]) @ t.T
            w[dead[i]] = v[dead[i]]
            v = w / w.sum(1, keepdims=True)
        post = (a * b).reshape(-1, k)[where]
        return post / post.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list = [(UND, 0.0)] * len(texts)
        which, words, sizes = [], [], []
        for i, t in enumerate(texts):
            if t and LETTER.search(t):
                w = words_of(t)
                which.append(i)
                words += w
                sizes.append(len(w))
        if not which or not self.labels:
            return out
        got = self.look(words).astype(float)
        post = self.posteriors(got[:, :-1], sizes) * got[:, -1:]
        sums = np.add.reduceat(post, np.r_[0, np.cumsum(sizes)[:-1]])
        sums /= sums.sum(1, keepdims=True)
        for i, s in zip(which, sums):
            j = int(s.argmax())
            out[i] = (self.labels[j], float(min(1.0, max(0.0, s[j]))))
        return out


def passages(rows: list[tuple[str, str]], labels: list[str], limit: int = TRAIN_WORDS, seed: int = 9) -> list[tuple[list[str], np.ndarray]]:
    """Passages of 24 words of the labelled texts, in turn by language; every other one is spliced with a
    passage of another text."""
    r = np.random.default_rng(seed)
    cut: dict[str, list[list[str]]] = {x: [] for x in labels}
    for text, lang in rows:
        w = words_of(text)
        cut[lang] += [w[i : i + 24] for i in range(0, len(w), 24)]
    for v in cut.values():
        r.shuffle(v)
    share = limit // 24 // max(1, len(labels))
    plain = [(words, labels.index(x)) for x in labels for words in cut[x][:share]]
    r.shuffle(plain)
    out = []
    for i, (words, y) in enumerate(plain):
        if i % 2 and len(words) > 4:
            other, z = plain[i - 1]
            k = int(r.integers(2, len(words) - 1))
            out.append((words[:k] + other[k:], np.r_[np.full(k, y), np.full(len(other[k:]), z)].astype(int)))
        else:
            out.append((words, np.full(len(words), y)))
    return [p for p in out if p[0]]


def train(rows: list[tuple[str, str]]) -> Field:
    labels = sorted({x for _, x in rows})
    return Field(labels).fit(passages(rows, labels)) if labels else Field([])


def fit_from(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """Fits on at most `rows` documents of the training folds that have a text and a language."""
    may = docs.select("doc_id", "text", "lang").where(train_fold(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return train([(r[0], r[1]) for r in sampled_rows(may, "doc_id", rows, ["text", "lang"]) if LETTER.search(r[0])])


def batches_of(size: int = 800_000) -> Callable:
    """Splits a list of texts into runs of about `size` characters."""

    def split(texts: list[str]):
        at = total = 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= size:
                yield at, i + 1
                at, total = i + 1, 0
        if at < len(texts):
            yield at, len(texts)

    return split


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: Field | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    model = model if model is not None else fit_from(docs)
    split = batches_of()

    def fill(texts):
        texts = [t or "" for t in texts]
        got = [g for x, y in split(texts) for g in model.predict(texts[x:y])]
        return [g[0] for g in got], [g[1] for g in got]

    return mapped_texts(docs, fill, "lang_pred string, score double", text, id_col)


def keep_identified(docs: DataFrame, text: str = "text", least: float = 0.35, model: Field | None = None) -> DataFrame:
    """The rows whose language is told with a score of at least `least`: all columns, unchanged. Rows of
    null texts, or of texts without a letter, go; so do those whose words no language explains."""
    model = model if model is not None else fit_from(docs)
    split = batches_of()
    at = docs.columns.index(text)

    def fill(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, at)):
            texts = [t or "" for t in b.column(at).to_pylist()]
            good = []
            for x, y in split(texts):
                good += [lang != UND and score >= least for lang, score in model.predict(texts[x:y])]
            yield b.filter(pa.array(good, type=pa.bool_()))
        tidy()

    return docs.mapInArrow(fill, docs.schema)
