"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read from a file whose path is a parameter; it is never
trained and no copy of it is kept.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of the public byte-level BPE for many languages lies.
VOCABULARY = os.environ.get("TALLYLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how that BPE cuts text into words before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer; special tokens in a text are ordinary text."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of each text; null texts have 0."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    source = df.select(*keep, F.col(text).alias("__text"))

    def count(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            sizes = [len(t) for t in enc.encode_ordinary_batch([t or "" for t in batch.column("__text").to_pylist()], num_threads=1)]
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*keep, out])

    return source.mapInArrow(count, f"{kept}, `{out}` bigint")
