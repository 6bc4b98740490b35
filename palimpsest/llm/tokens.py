"""Sizes of texts in tokens of a public tokenizer. The folder of the vocabulary files is a parameter."""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):  # noqa: ANN201
    """The byte-level BPE encoder, loaded once in a Python worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_at", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (Path(folder) / vocabulary).open("rb"))}
    return tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens; 0 for null and empty text."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(folder, vocabulary)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return run(text)
