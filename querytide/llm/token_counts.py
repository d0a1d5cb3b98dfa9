"""Token counts under a unigram vocabulary without building the tokens.

An Aho-Corasick automaton finds every vocabulary piece that ends at a character; dynamic programming
over the ends carries the best score and its number of tokens. Rules of the tokenizer: a piece wins over
another path to the same end only with a greater score, and paths are tried from the earliest start, so
among equal scores the longest last piece stays; a character that is no piece scores `least - 10` and
counts as its UTF-8 bytes where the vocabulary has all byte pieces, else a run of them as one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]  # ordinary pieces and their scores
    byte_fallback: bool
    least: float

    @staticmethod
    def from_model(path: str) -> "Vocabulary":
        """Pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = tuple((model.id_to_piece(i), model.get_score(i)) for i in plain)
        return Vocabulary(pieces, sum(map(model.is_byte, ids)) == 256, min((s for _, s in pieces), default=0.0))


class Counter:
    """Counts tokens of texts; remembers up to `cache` stretches between which no piece can lie."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE_WORDS):
        import ahocorasick

        self.v, self.cache, self.known = vocabulary, cache, {}
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary.pieces:
            if piece:
                scores.setdefault(piece, score)
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.empty = not scores
        # a stretch is a run of spaces and what follows it; line ends stand alone: true cuts only if no piece crosses one
        cuts = all(re.fullmatch(f"{SPACE}*[^{SPACE}\n]*|\n", p) for p in scores)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if cuts else r"(?s).+")

    def best(self, text: str) -> int:
        """Tokens of the best path through one stretch."""
        n, unknown = len(text), self.v.least - UNKNOWN_PENALTY
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self.empty:
            for end, match in self.automaton.iter(text):
                ends[end].append(match)
        score, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top, tokens, run, single = None, 0, False, False
            for length, s in sorted(ends[end], reverse=True):  # the earliest start first
                start = end + 1 - length
                single = single or length == 1
                if top is None or score[start] + s > top:
                    top, tokens, run = score[start] + s, count[start] + 1, False
            if not single and (top is None or score[end] + unknown > top):
                top = score[end] + unknown
                if self.v.byte_fallback:
                    tokens, run = count[end] + len(text[end].encode("utf-8", "surrogatepass")), False
                else:
                    tokens, run = count[end] + (0 if open_run[end] else 1), True
            score[end + 1], count[end + 1], open_run[end + 1] = top, tokens, run
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.v.byte_fallback:
            return self.best(text)  # a run of unknown characters may lie across stretches
        known, total = self.known, 0
        for stretch in self.stretch.findall(text):
            tokens = known.get(stretch)
            if tokens is None:
                if len(known) >= self.cache:
                    known.clear()
                tokens = self.best(stretch)
                if len(stretch) <= 64:
                    known[stretch] = tokens
            total += tokens
        return total


@functools.lru_cache(maxsize=2)
def _counter(model_path: str) -> Counter:
    return Counter(Vocabulary.from_model(model_path))


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id_column` and n_tokens of every whole text; one leading space is implied, as the tokenizer has it.

    Null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives no rows;
    other columns are ignored. Each executor reads the vocabulary at `model_path` (part of its Python).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_column, "n_tokens"])

    slim = docs.select(id_column, text_column)
    return slim.mapInArrow(run, f"`{id_column}` {slim.schema[0].dataType.simpleString()}, n_tokens bigint")
