"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
#: The pre-splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``tokens`` of every row; a null or empty text has no token.

    The vocabulary is read once by the driver and broadcast, so executors need no copy of the file.
    """
    with open(vocabulary, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())
    pattern = PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.value.splitlines()) }
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{schema}, tokens bigint")
