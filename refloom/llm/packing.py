"""Vector bin packing of training examples, and the documents packed by it.

A bin has three limits: tokens, segments and loss-bearing tokens. `pack` fills one bin at a time with
the dot-product heuristic: of the examples that still fit, take the one whose demand vector has the
largest dot product with the bin's remaining capacity, both as shares of the limits. Demands are kept
in classes (equal token and loss counts), so a choice costs one product over the classes.

`pack_documents` tokenizes whole texts, gives each full sequence of `limit` ids a bin of its own, packs
what remains and closes the gap that is left in a bin with a cut from the largest remaining example.
Every task packs its own scan partition in batches of bounded size: nothing is shuffled and a repeated
task gives the same rows. Where too few ids are left, or examples too small for `segments` of them to fill
a sequence, sequences are powers of two, which aren't padded.

Edge cases: a null or empty text is the single end id; repeated rows are packed as often as they occur;
an example beyond a limit on its own is refused by `pack` (ValueError) and cut by `pack_documents`.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import arrow_types, once, slices, tidy

LIMIT = 1024  #: tokens of a sequence
SEGMENTS = 32  #: pieces of a sequence
END_ID = 0  #: id that ends a document
POOL_TOKENS = 1 << 21  #: ids that a task holds while it packs
MEMO_WORDS = 400_000  #: word forms whose ids a Python worker keeps
END_OF_TEXT = "<|endoftext|>"


@dataclass(frozen=True)
class Limits:
    tokens: int = LIMIT
    segments: int = SEGMENTS
    loss_tokens: int = LIMIT


class Pool:
    """Examples by demand class; `best` is the dot-product choice."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.by: dict[tuple[int, int], list] = defaultdict(list)
        self.changed = True

    def add(self, tokens: int, loss: int, what) -> None:
        k = (tokens, loss)
        self.changed |= not self.by.get(k)
        self.by[k].append(what)

    def _refresh(self) -> None:
        self.keys = sorted(k for k, v in self.by.items() if v)
        self.k = np.array(self.keys, dtype=np.float64).reshape(-1, 2)
        self.share = self.k / (self.limits.tokens, self.limits.loss_tokens)
        self.changed = False

    def best(self, tokens: int, segments: int, loss: int) -> tuple[int, int] | None:
        """The class that fits with the largest product; of equal products the one with more tokens."""
        if self.changed:
            self._refresh()
        if not self.keys or segments < 1:
            return None
        n = self.limits
        score = self.share @ (tokens / n.tokens, loss / n.loss_tokens) + segments / n.segments / n.segments
        score[(self.k[:, 0] > tokens) | (self.k[:, 1] > loss)] = -1
        at = len(score) - 1 - int(np.argmax(score[::-1]))
        return self.keys[at] if score[at] >= 0 else None

    def take(self, k: tuple[int, int]):
        what = self.by[k].pop()
        if not self.by[k]:
            del self.by[k]
            self.changed = True
        return what

    def largest(self) -> tuple[int, int] | None:
        if self.changed:
            self._refresh()
        return self.keys[-1] if self.keys else None

    def reach(self, segments: int, enough: int) -> int:
        """Tokens of the largest examples, `segments` at most; it stops at `enough`."""
        self.largest()
        total = 0
        for k in reversed(self.keys):
            n = min(segments, len(self.by[k]))
            total, segments = total + n * k[0], segments - n
            if total >= enough or not segments:
                break
        return total

    def __len__(self) -> int:
        return sum(map(len, self.by.values()))


def pack(examples: list[tuple[int, int]], limits: Limits) -> list[list[int]]:
    """Bins of indexes of (tokens, loss tokens), none of which is cut."""
    pool, bins = Pool(limits), []
    for i, (tokens, loss) in enumerate(examples):
        if tokens > limits.tokens or loss > limits.loss_tokens:
            raise ValueError(f"example {i} is beyond a limit: {tokens} tokens, {loss} loss tokens")
        pool.add(tokens, loss, i)
    while len(pool):
        now, t, s, g = [], limits.tokens, limits.segments, limits.loss_tokens
        while k := pool.best(t, s, g):
            now.append(pool.take(k))
            t, s, g = t - k[0], s - 1, g - k[1]
        bins.append(now)
    return bins


def pack_examples(examples: DataFrame, limits: Limits = Limits(), batch: int = 50_000) -> DataFrame:
    """Instruction data: rows (example_id long, tokens long, loss_tokens long) get (sequence_id, offset).
    Examples stay whole; a null count is 0. Each task packs its rows in batches of at most `batch`."""

    def fill(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch].fillna(0)
                ids, tokens, loss = (part[c].astype("int64").tolist() for c in ("example_id", "tokens", "loss_tokens"))
                rows = []
                for one in pack(list(zip(tokens, loss)), limits):
                    offset = 0
                    for i in one:
                        rows.append((ids[i], tokens[i], loss[i], sequence, offset))
                        offset += tokens[i]
                    sequence += 1
                yield pd.DataFrame(rows, columns=["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])

    return examples.select("example_id", "tokens", "loss_tokens").mapInPandas(fill, "example_id long, tokens long, loss_tokens long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A space behind a visible character always begins a new pre-token of this tokenizer, so a text is
    encoded word by word and the ids of the first MEMO_WORDS word forms are kept; words go through the
    same vocabulary's rank file, which is quicker for short strings. Texts with runs of white space in
    which a space isn't last, or with the special token's string, are encoded whole."""

    def __init__(self, path: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.word = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}
        self.space = re.compile(r" \s|\s\s |[^\S \n\t\r]| \Z")

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.space.search(text) or END_OF_TEXT in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        memo, out = self.memo, [array("I", self.word(first)).tobytes()]
        for w in rest:
            ids = memo.get(w)
            if ids is None:
                ids = array("I", self.word(" " + w)).tobytes()
                if len(memo) < MEMO_WORDS:
                    memo[w] = ids
            out.append(ids)
        return b"".join(out)


class Cutter:
    """Packs the pieces of one task."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence, self.rows = limits, first_sequence, []
        self.pool, self.held = Pool(limits), 0

    def put(self, piece: tuple, offset: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        total, size = len(ids) // 4, self.limits.tokens
        for start in range(0, total - total % size, size):
            self.put((doc, start, ids[4 * start : 4 * (start + size)], total), 0)
            self.sequence += 1
        if rest := total % size:
            self.keep((doc, total - rest, ids[4 * (total - rest) :], total))

    def keep(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pool.add(n, n, piece)
        self.held += n

    def drop(self, k: tuple[int, int]) -> tuple:
        self.held -= k[0]
        return self.pool.take(k)

    def size(self) -> int:
        """Ids of the next bin: a whole one if the largest examples that `segments` allows fill it, else the
        largest power of two that they fill."""
        n = self.limits
        reach = self.pool.reach(n.segments, n.tokens)
        return n.tokens if reach >= n.tokens else 1 << (reach.bit_length() - 1)

    def bin(self, size: int) -> None:
        free, segments = size, self.limits.segments
        while free and (k := self.pool.best(free, segments - 1, free)):
            self.put(self.drop(k), size - free)
            free, segments = free - k[0], segments - 1
        if free:  # nothing fits, or one segment is left: the largest example is as large as the gap or larger, and is cut
            k = self.pool.largest()
            doc, start, ids, total = piece = self.drop(k)
            if k[0] > free:
                self.keep((doc, start + free, ids[4 * free :], total))
                piece = (doc, start, ids[: 4 * free], total)
            self.put(piece, size - free)
        self.sequence += 1

    def fill(self, until: int) -> None:
        """Fills bins until at most `until` ids are held."""
        while self.held > until and self.held >= self.limits.tokens:
            self.bin(self.size())

    def end(self) -> None:
        while self.held:
            self.bin(self.size())


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limits: Limits = Limits(), tokenizer: str | None = None) -> DataFrame:
    """(PIECES) of all documents; rows without an id are packed like any other."""
    path, types = tokenizer or tokenizer_path(), arrow_types(docs.sparkSession, PIECES)
    names, end = [c.split()[0] for c in PIECES.split(", ")], struct.pack("<I", END_ID)

    def fill(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def out(cutter):
            rows, cutter.rows = cutter.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)

        ids: Callable[[str], bytes] = once(f"ids of {path}", lambda: Ids(path))
        cutter = Cutter(limits, TaskContext.get().partitionId() << 40)
        for b in (part for whole in batches for part in slices(whole, 1)):
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cutter.add(doc, ids(t or "") + end)
                if cutter.held > POOL_TOKENS:
                    cutter.fill(POOL_TOKENS // 2)
                if len(cutter.rows) > 20_000:
                    yield out(cutter)
        cutter.end()
        yield out(cutter)
        tidy()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(fill, PIECES)


CONVERSATION = "conv_id long, start long, tokens long, loss_tokens long, sequence_id long, offset long"
TURN = "conv_id long, turn long, bears boolean, n long, mark long"


def pack_conversations(turns: DataFrame, limits: Limits = Limits(), tokenizer: str | None = None, trained: str = "assistant", batch: int = 20_000) -> DataFrame:
    """Instruction data: turns (conv_id, turn, role, text) -> (CONVERSATION), an example for each conversation: its turns
    in order, an end id behind each; the ids of `trained` turns bear loss. An example beyond a limit on its own is
    cut between turns, and a turn beyond one into pieces of the limit; others stay whole. Conversations meet by id,
    their turns come one after another, and a task packs at most `batch` pieces at a time, so its memory doesn't
    depend on a conversation's length.

    Edge cases: a null text is empty, a null role bears no loss, turns without a number come first, equal numbers
    in the order of their texts' checksums, rows without a conv_id are left out, repeated rows count each."""
    path, spark = tokenizer or tokenizer_path(), turns.sparkSession
    kinds, types, names = arrow_types(spark, TURN), arrow_types(spark, CONVERSATION), [c.split()[0] for c in CONVERSATION.split(", ")]

    def sizes(batches):
        import pyarrow as pa

        ids = once(f"ids of {path}", lambda: Ids(path))
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            own = [b.column(0), b.column(1), pa.array([r == trained for r in b.column(2).to_pylist()], type=kinds[2])]
            counts = [[len(ids(t)) // 4 + 1 for t in texts], [zlib.crc32(t.encode()) for t in texts]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, type=k) for c, k in zip(counts, kinds[3:])]], names=[c.split()[0] for c in TURN.split(", ")])
        tidy()

    def fill(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        sequence, waiting, now, piece = TaskContext.get().partitionId() << 40, [], None, Piece(limits)

        def out():
            nonlocal sequence, waiting
            rows = []
            for one in pack([(n, loss) for _, _, n, loss in waiting], limits):
                offset = 0
                for k in one:
                    rows.append((*waiting[k], sequence, offset))
                    offset += waiting[k][2]
                sequence += 1
            waiting = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)

        for b in batches:
            for i, bears, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if i != now:
                    waiting += [(now, *x) for x in piece.end()]
                    now, piece = i, Piece(limits)
                waiting += [(i, *x) for x in piece.add(n, bears)]
                if len(waiting) >= batch:
                    yield out()
        waiting += [(now, *x) for x in piece.end()]
        yield out()

    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(sizes, TURN)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "mark", "n").mapInArrow(fill, CONVERSATION)


class Piece:
    """Cuts one example, turn by turn, into (start, tokens, loss tokens) within the limits."""

    def __init__(self, limits: Limits):
        self.limits, self.at, self.n, self.loss = limits, 0, 0, 0

    def add(self, size: int, bears: bool) -> list[tuple[int, int, int]]:
        """What is complete once the next turn is known."""
        most, out = min(self.limits.tokens, self.limits.loss_tokens) if bears else self.limits.tokens, []
        if self.n + size > self.limits.tokens or self.loss + size * bears > self.limits.loss_tokens:
            out += self.end()
        while size > most:
            out.append((self.at, most, most * bears))
            self.at, size = self.at + most, size - most
        self.n, self.loss = self.n + size, self.loss + size * bears
        return out

    def end(self) -> list[tuple[int, int, int]]:
        out = [(self.at, self.n, self.loss)] if self.n else []
        self.at, self.n, self.loss = self.at + self.n, 0, 0
        return out
