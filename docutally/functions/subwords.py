"""Subword tokens from a vocabulary file of the tokenizers library."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts that are encoded or decoded at a time.
AT_A_TIME = 16


def _loaded(path: str):
    """The tokenizer of a file, read once per Python worker."""
    cache = vars(sys.modules.setdefault("_docutally_tokenizers", types.ModuleType("_docutally_tokenizers")))
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        cache[path] = tokenizer
    return cache[path]


def subword_tokens(path: str) -> Callable[[Column], Column]:
    """Function from a text column to its token ids (null: none), with the vocabulary file at ``path`` on every machine."""

    def encode(texts: pa.Array) -> pa.Array:
        tokenizer, kind = _loaded(path), pa.list_(pa.int32())
        # An encoding holds words, places and masks besides its ids, some hundred bytes a token: few are kept at a time.
        parts = [pa.array([], kind)]
        for at in range(0, len(texts), AT_A_TIME):
            found = tokenizer.encode_batch_fast([t or "" for t in texts.slice(at, AT_A_TIME).to_pylist()], add_special_tokens=False)
            parts.append(pa.array([e.ids for e in found], kind))
        return pa.concat_arrays(parts)

    return F.arrow_udf(encode, "array<int>")


def subword_text(path: str) -> Callable[[Column], Column]:
    """Function from a column of token ids to their text."""

    def decode(ids: pa.Array) -> pa.Array:
        tokenizer = _loaded(path)
        parts = [pa.array([], pa.string())]
        for at in range(0, len(ids), AT_A_TIME):
            parts.append(pa.array(tokenizer.decode_batch([i or [] for i in ids.slice(at, AT_A_TIME).to_pylist()], skip_special_tokens=False), pa.string()))
        return pa.concat_arrays(parts)

    return F.arrow_udf(decode, "string")
