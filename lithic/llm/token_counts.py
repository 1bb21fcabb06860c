"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

A text's pre-tokens are its words, each with a mark of the space before it. The distinct pre-tokens of a block of documents
go into a trie in sorted order, and the forward scores of a prefix are worked out once for all pre-tokens that share it;
the end of a pre-token stores how many pieces its best segmentation has. Documents sum the stored counts of their words.
Blocks are of bounded size and lie where the documents are read, so nothing is shuffled.

A piece's log probability is that of its place in the vocabulary by Zipf's law. A character that no piece covers costs its
UTF-8 bytes, as pieces of the lowest probability. Of equally likely segmentations the one of fewer pieces counts.

Defined results: null or empty text, and white space alone, has no tokens; ids may be null or repeat, each row is counted
by itself; words of any length are handled in time proportional to their length; an empty table gives no rows; other
columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm.common import small_batches, text_or_empty
from lithic.llm.words import by_bytes, split_words

SPACE = "▁"


class Unigram:
    """Pieces with log probabilities, and the forward pass over a trie of pre-tokens."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.prefixes = {p[-n:] for p in pieces for n in range(1, len(p) + 1)}  # suffixes of pieces: where a match may go on backwards

    def extend(self, word: str, at: int, best: list[float], count: list[int]) -> None:
        """Appends the forward score and piece count of word[:at + 1], from those of its shorter prefixes."""
        get, end = self.pieces.get, at + 1
        score, n = -math.inf, 0
        for start in range(at, max(-1, at - self.longest), -1):
            part = word[start:end]
            p = get(part)
            if p is None:
                if part not in self.prefixes:
                    break
                continue
            s, m = best[start] + p, count[start] + 1
            if s > score or (s == score and m < n):
                score, n = s, m
        if word[at] not in self.pieces:
            size = len(word[at].encode("utf-8", "surrogatepass"))
            s, m = best[at] + size * self.unknown, count[at] + size
            if s > score or (s == score and m < n):
                score, n = s, m
        best.append(score)
        count.append(n)

    def counts(self, words: list[str]) -> list[int]:
        """The piece count of each of the sorted distinct words: depth first through their trie."""
        out, before, best, count = [], "", [0.0], [0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for at in range(shared, len(word)):
                self.extend(word, at, best, count)
            out.append(count[-1])
            before = word
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Unigram:
    """The pieces of a sentencepiece model by Zipf's law on their places."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1.0 / k for k in range(1, len(kept) + 1)))
    return Unigram({model.id_to_piece(i): -math.log(k) - total for k, i in enumerate(kept, 1)})


def _counter(path: str, id_type: pa.DataType, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for whole in batches:
            for batch in by_bytes(whole, 1, block):
                words = split_words(batch.column(1), lower=False)
                _, at, where = np.unique(words.hash, return_index=True, return_inverse=True)
                data = words.data.tobytes()
                distinct = [SPACE + data[words.start[i]:words.end[i]].decode("utf-8", "surrogatepass") for i in at]
                order = sorted(range(len(distinct)), key=distinct.__getitem__)
                per_word = np.zeros(len(distinct), np.int64)
                per_word[order] = model.counts([distinct[i] for i in order])
                n_words = np.diff(words.first)
                tokens = np.bincount(words.doc, weights=per_word[where], minlength=batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(tokens), pa.array(n_words.astype(np.int64))], names=["id", "n_tokens", "n_words"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = 8 << 20) -> DataFrame:
    """A row per document: id, n_tokens, n_words. The vocabulary is read from the same path on every machine."""
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType
    return source.mapInArrow(_counter(vocabulary_path, to_arrow_type(kind), block), f"id {kind.simpleString()}, n_tokens long, n_words long")
