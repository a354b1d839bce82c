"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is read where it lies."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(path: str):
    """The tokenizer of a ranks file, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, text_col: str, keep: dict[str, str], path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The columns named in ``keep`` (name to SQL type) and ``tokens`` BIGINT; rows with a null text are left out."""

    def count(batches):
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col), *[F.col(c).cast(t) for c, t in keep.items()])
    return rows.mapInArrow(count, ", ".join(f"{c} {t}" for c, t in keep.items()) + ", tokens long")
