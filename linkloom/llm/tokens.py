"""Sizes of texts in tokens of a public tokenizer; the vocabulary file stays where it is, its path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_LOADED: dict[str, object] = {}


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def words_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def word_ranks(path: str) -> Callable[[str], int]:
    """The rank, from 1, of a lower-case word in a vocabulary whose pieces were merged in order of frequency; a word of k
    pieces comes k - 1 times the vocabulary's size after those of one."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        size = known.get_vocab_size()

        @lru_cache(maxsize=1 << 17)
        def rank(word: str) -> int:
            pieces = known.encode(word, add_special_tokens=False).ids
            return pieces[0] + 1 if len(pieces) == 1 else max(len(pieces), 2) * size

        _LOADED[path] = rank
    return _LOADED[path]


def tokenizer(path: str):
    """The byte-level BPE of a rank file, loaded once per worker."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_tokens(texts: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``texts`` with a column ``tokens`` in place of ``text``; null and empty texts have 0."""
    where = path or default_path()

    @F.pandas_udf("long")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = tokenizer(where)
        for part in parts:
            yield pd.Series([len(known.encode_ordinary(x)) if x else 0 for x in part], dtype="int64")

    return texts.withColumn("tokens", size(F.col(text))).drop(text)
