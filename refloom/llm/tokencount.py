"""Count-only Viterbi segmentation with a unigram vocabulary.

The tokenizer is a unigram model over a public vocabulary file's pieces and scores: spaces become a
mark that also begins the text, each mark begins a word, and words are segmented on their own. An
Aho-Corasick automaton lists the pieces that end at each character; dynamic programming carries the best
score, its piece count and the open unknown run, and no way back. Ties follow the tokenizer: a later candidate replaces an
earlier one only if its score is greater, and candidates come in order of their start, so the longest
piece wins. A character without a piece costs the lowest score less 10; neighbouring ones fuse into one
unknown piece, which counts as its UTF-8 bytes if the vocabulary has all byte pieces, else as one.

Edge cases: a null or empty text has 0 tokens; repeated rows and rows without an id count each; any length is
one pass, and a task's memory is that of a batch of texts, of its longest word and of MEMO_WORDS word forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from refloom.llm.common import mapped_texts, once

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 400_000  #: word forms whose counts a Python worker keeps


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) in order of id, from a sentencepiece model file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.known: dict[str, float] = {}
        for p, s in pieces:
            if p:
                self.known[p] = s
                self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.memo: dict[str, int] = {}

    def segment(self, word: str) -> int:
        """Pieces of the best path through one word. Of each place only the best score, its count of pieces and the
        start of the unknown run that is open there (or -1) are carried; that run counts when it is closed."""
        n = len(word)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, (size, value) in self.auto.iter(word):
            ends[end].append((end + 1 - size, value))
        for end in range(n):
            best, single = None, False
            for start, value in sorted(ends[end]):  # earliest start first: it wins a tie
                s = score[start] + value
                single |= start == end
                if best is None or s > best:
                    best = s
                    k = count[start] + 1 + (self._unknown(word[run[start] : start]) if run[start] >= 0 else 0)
                    open_at = -1
            if not single:
                s = score[end] + self.unknown
                if best is None or s > best:
                    best, k, open_at = s, count[end], run[end] if run[end] >= 0 else end
            score[end + 1], count[end + 1], run[end + 1] = best, k, open_at
        return count[n] + (self._unknown(word[run[n] :]) if run[n] >= 0 else 0)

    def _unknown(self, run: str) -> int:
        if run in self.known:
            return 1
        return len(run.encode()) if self.bytes else 1

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:  # the text begins with a space, which is the leading mark
            words = words[1:]
        memo, total = self.memo, 0
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.segment(MARK + w)
                if len(memo) < MEMO_WORDS:
                    memo[w] = n
            total += n
        return total


def token_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens long) for every row; the vocabulary goes to the tasks as a broadcast of its fixed size, and a
    Python worker builds the automaton once."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))
    made = f"tokens of {model_file}"

    def fill(texts):
        count = once(made, lambda: Counter(pieces.value))
        return ([count(t) if t else 0 for t in texts],)

    return mapped_texts(docs, fill, "n_tokens long", text, id_col)
