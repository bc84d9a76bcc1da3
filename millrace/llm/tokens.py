"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

#: Vocabulary file by default: byte-level BPE as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest vocabulary file that is sent to the tasks.
MAX_BYTES = 64 << 20


@lru_cache(maxsize=2)
def _encoding(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(content.value).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64())], names=[*b.schema.names[1:], "n_tokens"])

    return run


def token_counts(df: DataFrame, text: str | Column, keep: dict[str, str], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``df``: the columns of `keep` (new name: column), n_tokens. Null and empty texts have no tokens."""
    spark = df.sparkSession
    ship(spark)
    content = Path(vocabulary).read_bytes()
    if len(content) > MAX_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_BYTES} bytes")
    shared = spark.sparkContext.broadcast(content)
    source = df.select((F.col(text) if isinstance(text, str) else text).alias("text"), *[F.col(c).alias(n) for n, c in keep.items()])
    fields = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in keep)
    return source.mapInArrow(_count(shared), f"{fields}, n_tokens bigint")
