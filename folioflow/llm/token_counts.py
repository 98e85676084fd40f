"""Token counts under a unigram model by trie-shared dynamic programming.

A text's pre-tokens are its words, each behind the mark of a word's start. A pre-token's tokens are the pieces of its best
segmentation: the largest sum of scores, and of equal sums the fewest pieces. A worker puts the distinct new pre-tokens of some texts in a
trie, whose depth-first walk is their sorted order: the forward scores of a prefix stay on the walk's stack and serve
every word below it. Each terminal's count is stored, and documents add up the counts of their words.

Pieces come from a public vocabulary file, whose order stands for their frequency: the n-th has the score -log(n + 1).
A character that no piece covers costs a byte piece for each of its bytes, at a score below all others.

Results in edge cases: null, empty and white texts have 0 words and 0 tokens; every row is counted on its own, whatever
its doc_id; an empty table gives no rows. Words of any length are segmented whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY_FILE = "piece_bpe_32k.model"
#: Fixed value: the mark of a word's start in the vocabulary.
MARK = "▁"
#: Words whose counts a worker remembers, twice: those used lately and those used before.
MEMORY = 400_000
#: Texts whose words are put in one trie.
TEXTS = 2000


class Unigram:
    """Scores of pieces, in whole millionths so that sums are exact."""

    def __init__(self, pieces: list[str]):
        self.scores = {p: -round(math.log(n + 2) * 1e6) for n, p in enumerate(pieces)}
        self.unknown = min(self.scores.values(), default=0) - 10_000_000
        self.longest: dict[str, int] = {}  # by last character
        for p in pieces:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(s.get_piece_size()) if s.is_unknown(i) or s.is_control(i) or s.is_byte(i) or s.is_unused(i)]
        return cls([s.id_to_piece(i) for i in range(s.get_piece_size()) if i not in set(special)])

    def count(self, words: list[str]) -> dict[str, int]:
        """The number of tokens of each distinct word."""
        scores, longest, unknown = self.scores, self.longest, self.unknown
        counts: dict[str, int] = {}
        best, used, before = [0], [0], ""
        for word in sorted(set(words)):
            s = MARK + word
            shared = 0
            limit = min(len(s), len(before))
            while shared < limit and s[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(s) + 1):
                last = s[end - 1]
                width = 1 if last < "\x80" else len(last.encode("utf-8", "surrogatepass"))
                top, least = best[end - 1] + unknown * width, used[end - 1] + width
                for start in range(max(0, end - longest.get(last, 0)), end):
                    score = scores.get(s[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and used[start] + 1 < least):
                            top, least = score, used[start] + 1
                best.append(top)
                used.append(least)
            counts[word] = used[-1]
            before = s
        return counts


_models: dict[str, tuple[Unigram, list[dict[bytes, int]]]] = {}


def _counting(path: str, keep: str = "doc_id"):
    """keep: the column that stays beside the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = (Unigram.load(path), [{}, {}])
        model, memory = _models[path]
        for batch in batches:
            texts, n_words, n_tokens = batch.column("text").cast(pa.binary()), [], []
            for at in range(0, batch.num_rows, TEXTS):
                split = [(t or b"").split() for t in texts.slice(at, TEXTS).to_pylist()]
                if len(memory[0]) > MEMORY:
                    memory[:] = [{}, memory[0]]
                known, old = memory
                new = [w for w in set().union(*split) if w not in known]
                known.update((w, old[w]) for w in new if w in old)
                known.update((w.encode(), n) for w, n in model.count([w.decode() for w in new if w not in old]).items())
                n_words += map(len, split)
                n_tokens += [sum(map(known.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [keep, "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, n_words, n_tokens."""
    return docs.select("doc_id", "text").mapInArrow(_counting(vocabulary), "doc_id bigint, n_words bigint, n_tokens bigint")


def totals(docs: DataFrame, vocabulary: str, by: str) -> DataFrame:
    """by, n_docs, n_words, n_tokens: sums over the rows of each value of a text column of docs."""
    numbered = docs.select(F.col(by).cast("string").alias("by"), "text")
    d = numbered.mapInArrow(_counting(vocabulary, "by"), "by string, n_words bigint, n_tokens bigint")
    return d.groupBy(F.col("by").alias(by)).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_FILE))
