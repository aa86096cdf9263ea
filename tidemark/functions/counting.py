"""Token counters (E7, E8). The default needs no vocabulary; a rank file gives real token counts."""

from __future__ import annotations

import base64
import os
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How texts are split before byte pairs are joined, as public tokenizers do it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter(Protocol):
    additive: bool

    def count(self, text: str) -> int: ...

    def truncate(self, text: str, most: int) -> str: ...


class PatternCounter:
    """Words and single signs count as tokens: the same everywhere, offline."""

    pattern = re.compile(r"\w+|[^\w\s]")
    additive = True  # words set apart by blanks have the sum of their counts

    def count(self, text: str) -> int:
        return sum(1 for _ in self.pattern.finditer(text or ""))

    def truncate(self, text: str, most: int) -> str:
        if most <= 0:
            return ""
        for n, m in enumerate(self.pattern.finditer(text), 1):
            if n == most:
                return text[: m.end()]
        return text


class WordCounter(PatternCounter):
    """Words between white space."""

    pattern = re.compile(r"\S+")


class RankFileCounter:
    """Byte-pair tokens of a rank file, loaded on first use in each process."""

    additive = False

    def __init__(self, path: str, pattern: str = SPLIT):
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self):
        return {**self.__dict__, "_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text or ""))

    def truncate(self, text: str, most: int) -> str:
        ids = self.encoding.encode_ordinary(text)
        return text if len(ids) <= most else self.encoding.decode(ids[: max(most, 0)])


def default_counter(ranks: str = "") -> TokenCounter:
    """Real tokens where a rank file is named and there, else words and signs."""
    return RankFileCounter(ranks) if ranks and os.path.exists(ranks) else PatternCounter()


def with_tokens(df: DataFrame, counter: TokenCounter, most: int, text: str = "text") -> DataFrame:
    """df with n_tokens, the count of its text, and head, the text's first tokens (E7, E8); nulls stay null."""

    @F.pandas_udf("n_tokens int, head string")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = texts.notna()
        counts = [counter.count(t) if ok else None for t, ok in zip(texts, known)]
        heads = [counter.truncate(t, most) if ok else None for t, ok in zip(texts, known)]
        return pd.DataFrame({"n_tokens": pd.array(counts, "Int32"), "head": heads})

    found = df.withColumn("__tokens", run(F.col(text)))
    return found.withColumns({"n_tokens": F.col("__tokens.n_tokens"), "head": F.col("__tokens.head")}).drop("__tokens")
