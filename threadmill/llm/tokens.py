"""Token counts with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread

#: A byte-level BPE vocabulary as ranks; must lie at this path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's published splitting pattern (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """id, n_tokens of every row's whole text; 0 for null and empty texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "n_tokens": [len(encode(t)) if t else 0 for t in f["text"]]})

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return spread(docs, "id").mapInPandas(run, "id long, n_tokens long")
