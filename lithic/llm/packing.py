"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences of max_len and the binary digits of the rest, longest first. Each piece
is a sequence of its own, so no sequence crosses documents and none needs padding; pieces of equal length form a bucket
(column `length`), from which batches of one shape are drawn. Pieces are made where the document is read: no shuffle.

Defined results: null or empty text is the end token alone; an id may be null or repeat, each row is packed by itself; an
empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import small_batches, text_or_empty

#: Runs of this many characters without a change between white space and the rest go to the library whose merges take
#: n log n steps; the faster one takes n squared there.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def _paths(tokenizer: str) -> str:
    """The rank file beside a tokenizer file: the same vocabulary."""
    return tokenizer.removesuffix(".json") + ".tiktoken"


@lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """A function text -> ids, equal to tokenizers.Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids.

    The rank file of the same vocabulary is encoded several times faster; texts that hold a special token's string, or
    very long runs, are encoded by the tokenizer file itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(_paths(tokenizer), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) >= 1000 and LONG_RUN.search(text)):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Full pieces, then the powers of two of the rest, longest first."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(tokenizer: str, max_len: int, end_id: int, id_type: pa.DataType, rows_at_once: int = 256):
    schema = pa.schema([("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()), ("doc_tokens", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                out: list[tuple] = []
                for i, text in zip(ids, texts, strict=True):
                    tokens = np.array([*encode(text), end_id], dtype="<u4")
                    start = 0
                    for n in piece_lengths(len(tokens), max_len):
                        out.append((i, start, n, tokens[start:start + n].tobytes(), len(tokens)))
                        start += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return pack


def pack(docs: DataFrame, tokenizer: str, max_len: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, start, length, tokens (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    max_len is a power of two. sequence_id numbers the rows of each input split, so a task that runs again gives the same.
    """
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(source.schema["id"].dataType)
    pieces = source.mapInArrow(_packer(tokenizer, max_len, end_id, id_type), f"id {kind}, start long, length long, tokens binary, doc_tokens long")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def unpack(pieces: DataFrame) -> DataFrame:
    """(id, doc_tokens, tokens): the documents' ids back from their pieces, for round trips."""
    parts = F.array_sort(F.collect_list(F.struct("start", "tokens")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["tokens"]))
    return pieces.groupBy("id", "doc_tokens").agg(whole.alias("tokens"))
