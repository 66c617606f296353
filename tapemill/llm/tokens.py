"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

#: The vocabulary's file; a full path may stand in its place.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(4)
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer, once per process. Strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(hashlib.sha1(str(path).encode()).hexdigest(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sound(text: str) -> str:
    """The text without lone surrogates, which no encoder takes."""
    return text.encode("utf-8", "replace").decode("utf-8")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where their files are too few to occupy them; otherwise as they are, without shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(3 * cores)
