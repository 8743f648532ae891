"""Token counts of a unigram tokenizer without building its tokens.

The counts are those of a unigram model over the vocabulary: words are split before blanks,
each blank standing at the head of the word after it as U+2581; a word's best segmentation is
the one of highest total score. An Aho-Corasick automaton reports every vocabulary piece in a
word, and dynamic programming over positions carries only the best score and its number of
pieces.

Tie rules are the tokenizer's: positions are settled from left to right, and at a position a
later start wins only with a strictly higher score, so the longer last piece stays. A
character that is no piece by itself may stand as unknown, at the lowest score less ten;
neighbouring unknown characters count as the bytes they are made of.

Cases: a null or empty text has no tokens and score 0; repeated rows give repeated results;
other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, texts_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose result a task remembers, and the longest of them.
REMEMBERED = 200_000
REMEMBERED_CHARS = 32
NOTHING = float("-inf")
NO_MATCH = (-1, None)


def read_pieces(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@dataclass
class Counter:
    """Counts tokens and scores of words against one vocabulary."""

    pieces: list[tuple[str, float]]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        self.matcher = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.single = {p for p, _ in self.pieces if len(p) == 1}
        self.unknown = min(s for _, s in self.pieces) - UNKNOWN_PENALTY

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word's best segmentation."""
        found = self.known.get(word)
        if found is None:
            found = self._best(word)
            if len(word) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def _best(self, word: str) -> tuple[int, float]:
        score, count = [NOTHING] * (len(word) + 1), [0] * (len(word) + 1)
        score[0] = 0.0
        # Matches come by their end, longest first, so starts go up at each end.
        if self.single.issuperset(word):
            for end, (length, value) in self.matcher.iter(word):
                end += 1
                total = score[end - length] + value
                if total > score[end]:
                    score[end], count[end] = total, count[end - length] + 1
            return count[-1], score[-1]
        matches = self.matcher.iter(word)
        stop, hit = next(matches, NO_MATCH)
        for at, char in enumerate(word):
            end = at + 1
            while stop == at:
                length, value = hit
                total = score[end - length] + value
                if total > score[end]:
                    score[end], count[end] = total, count[end - length] + 1
                stop, hit = next(matches, NO_MATCH)
            if char not in self.single and score[at] + self.unknown > score[end]:
                score[end] = score[at] + self.unknown
                count[end] = count[at] + len(char.encode("utf-8", "surrogatepass"))
        return count[-1], score[-1]

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        marked = (text if text[0] in " ▁" else " " + text).replace(" ", SPACE)
        total, score = 0, 0.0
        for rest in marked.split(SPACE)[1:]:
            n, s = self.word(SPACE + rest)
            total += n
            score += s
        return total, score


def count(docs: DataFrame, pieces: list[tuple[str, float]], *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) for every row. The vocabulary is sent to the tasks; its size is
    the tokenizer's, not the data's."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        counter = Counter(vocabulary.value)

        def work(batch: pa.RecordBatch):
            found = [counter.text(t) for t in texts_of(batch, "__text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([s for _, s in found], pa.float64())], [id_col, "n_tokens", "score"])

        return work

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return map_batches(rows, make, f"`{id_col}` {id_type}, n_tokens bigint, score double")
