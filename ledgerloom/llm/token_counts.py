"""Token counts without tokens: an Aho-Corasick automaton over a unigram vocabulary and a Viterbi pass that keeps two numbers.

The pass carries the best score and the piece count of each prefix. Ties are the tokenizer's: a later match wins only by a
greater score, matches starting earlier come first, and a character that is no piece by itself costs the least score less 10.
Scores add up in double precision.
"""

from __future__ import annotations

import ahocorasick
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import pieces
from .common import append_columns, held, table

#: What an unknown character costs beyond the least score.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers.
CACHE_WORDS = 400_000

_LOW = float("-inf")


class Counter:
    def __init__(self, vocabulary: pieces.Pieces):
        self.automaton = ahocorasick.Automaton()
        self.single = {p for p in vocabulary.scores if len(p) == 1}
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.scores:
            self.automaton.make_automaton()
        self.unknown = vocabulary.least - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_ids is not None
        self.known: dict[str, tuple[int, float]] = {}

    def of_word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path over one word as pieces spell it."""
        n = len(word)
        best, count, unknown = [_LOW] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(word) if self.single or len(self.automaton) else iter(())
        end, found = next(matches, (n, None))
        for at in range(n):
            top = _LOW
            while found and end == at:  # the longest first, so by ascending start
                start = at + 1 - found[0]
                score = best[start] + found[1]
                if score > top:
                    top, best[at + 1], count[at + 1] = score, score, count[start] + 1
                end, found = next(matches, (n, None))
            if word[at] not in self.single:
                score = best[at] + self.unknown
                if score > top:
                    best[at + 1], unknown[at + 1] = score, True
                    count[at + 1] = count[at] + (len(word[at].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[at])
        return count[n], best[n]

    def __call__(self, text: str | None) -> tuple[int, float]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        total, score = 0, 0.0
        for w in pieces.words(text):
            got = known.get(w)
            if got is None:
                got = known[w] = self.of_word(pieces.SPACE + w)
            total += got[0]
            score += got[1]
        return total, score


def counter(path: str) -> Counter:
    return held(("counts", path), lambda: Counter(pieces.load(path)))


_FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])


def count_tokens(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens and score of each whole text under the file's pieces and scores as a unigram model; no shuffle.

    Null and empty texts: 0 tokens, score 0. Repeated rows are counted each; an empty table gives an empty table. Columns of
    docs called n_tokens or score are replaced.
    """

    def make():
        count = counter(model)

        def work(texts):
            made = [count(t) for t in texts]
            return [[n for n, _ in made], [s for _, s in made]]

        return work

    return append_columns(docs, _FIELDS, [text_col], make)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public piece file has merge ranks as scores; here they are the scores of a unigram model of the same pieces."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "score")
