"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (a parameter everywhere) and the pattern that cuts texts before merging, both fixed values of the tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents (text and any other columns) with n_tokens instead of text; null for null texts, 0 for empty ones.

    Whole texts are encoded, never prefixes.
    """
    rest = [f for f in documents.schema.fields if f.name not in ("text", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [None if t is None else len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(sizes, pa.int64())], names=[*(f.name for f in rest), "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return documents.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(run, f"{schema}, n_tokens long")


def source_name(c: str = "source"):
    """A source's name without blanks at its ends, lower-cased, `-` as `_`."""
    return F.lower(F.translate(F.trim(F.col(c)), "-", "_"))
