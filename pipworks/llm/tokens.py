"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Vocabulary as ranks (base64 bytes and rank on each line); another file can be given by the environment or as a parameter.
VOCABULARY = os.environ.get("PIPWORKS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the public byte-level vocabulary of this size splits text before merging (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and `tokens`, the number of tokens of the whole text, of every row with a text (0 for an empty one). No row moves."""
    fields = [documents.schema[c] for c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoding(vocabulary)
        for batch in batches:
            out = batch[keep].copy()
            out["tokens"] = [len(codec.encode_ordinary(t)) for t in batch["text"]]
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens long"])
    return documents.filter("text is not null").select(*keep, "text").mapInPandas(run, schema)
