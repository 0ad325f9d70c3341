"""Token counts by a count-only Viterbi over a unigram vocabulary.

The tokenizer is the unigram model of the ``tokenizers`` library with a word-start mark
(U+2581): spaces become marks, a mark is put before a text that does not start with one, and
the text is cut before each mark. An Aho-Corasick automaton enumerates all vocabulary pieces
that end at each character; the dynamic program keeps, for each end, only the best score and
its piece count, no back pointers and no pieces. Ties follow the tokenizer: a later candidate
must be strictly better, so the earliest start wins. A character that no one-character piece
covers may be unknown, at the least score minus ten; with byte fallback it counts its UTF-8
bytes, else a run of unknown characters counts one.

Defined results: null and empty texts count 0 tokens; texts of any length are counted whole;
repeated rows stay repeated. Vocabulary and scores are given by file; nothing is trained.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, trim

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's cache of word counts; a full cache is emptied.
CACHE_WORDS = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id from a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class CountViterbi:
    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.cache: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Pieces of the best path through one pre-token."""
        n = len(word)
        best, count, dead = [0.0] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        # tail: whether the best path into an end finishes with an unknown character
        tail = [False] * (n + 1)
        dead[0] = False
        at = 0  # first end that is not settled yet

        def settle(end: int, single: bool) -> None:
            if single:
                return
            s = best[end - 1] + self.unknown
            if dead[end] or s > best[end]:
                best[end], dead[end] = s, False
                count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.bytes else int(not tail[end - 1]))
                tail[end] = True

        single = True
        for last, (length, score) in self.auto.iter(word):
            end = last + 1
            if end != at:
                if at:
                    settle(at, single)
                for e in range(at + 1, end):
                    settle(e, False)
                at, single = end, False
            start = end - length
            s = best[start] + score
            if dead[end] or s > best[end]:
                best[end], count[end], dead[end], tail[end] = s, count[start] + 1, False, False
            if length == 1:
                single = True
        if at:
            settle(at, single)
        for e in range(at + 1, n + 1):
            settle(e, False)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        parts = text.split(MARK)
        if text[0] == MARK:
            del parts[0]
        cache, total = self.cache, 0
        for p in parts:
            c = cache.get(p)
            if c is None:
                c = self.count_word(MARK + p)
                if len(p) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[p] = c
            total += c
        return total


@lru_cache(maxsize=2)
def _counter(path: str, byte_fallback: bool) -> CountViterbi:
    return CountViterbi(read_vocabulary(path), byte_fallback)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """(id, n_tokens) per row."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        counter = _counter(vocabulary, byte_fallback)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], [id_col, "n_tokens"])
        trim()

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
