"""Sentences, hashing and token counts shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomstone.functions.tokens import TOKENIZER_DIR, VOCABULARY
from loomstone.functions.tokens import tokenizer as of_file

#: A sentence ends at a stop, also one inside closing marks, before white space, or at a line break.
_END = re.compile(r'(?<=[.!?…])\s+|(?<=[.!?…]["”»)\]])\s+|[\r\n]+')
_QUOTED = re.compile(r'«[^»]*»|“[^”]*”|"[^"]*"|\([^()]*\)')


def sentences(text: str) -> list[str]:
    """The pieces between sentence ends; blank ones are left out."""
    return [s for s in _END.split(text) if s and not s.isspace()]


def unquoted(sentence: str) -> str:
    """The sentence without quoted and parenthesised spans, unless these are most of it."""
    if "«" in sentence or "“" in sentence or '"' in sentence or "(" in sentence:
        bare = _QUOTED.sub(" ", sentence)
        if 2 * len(bare.strip()) >= len(sentence):
            return bare
    return sentence


#: The vocabulary file for a tokenizer's name. The file of the first name isn't available, so the
#: byte-level vocabulary for many languages stands in for it.
TOKENIZER_FILES = {"cl100k_base": VOCABULARY}


def tokenizer(name: str, folder: str = TOKENIZER_DIR):
    """The public byte-level tokenizer of that name."""
    return of_file(TOKENIZER_FILES.get(name, name if name.endswith(".tiktoken") else f"{name}.tiktoken"), folder)


def count_tokens(text: str | None, name: str, folder: str = TOKENIZER_DIR) -> int:
    """Tokens of a text; null and empty texts have none."""
    if not text:
        return 0
    return len(tokenizer(name, folder).encode_ordinary(text))


def with_token_counts(df: DataFrame, text: str, names: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """`df` with the text column replaced by a column `n_tokens_<i>` for the i-th tokenizer."""
    keep = [c for c in df.columns if c != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            for i, name in enumerate(names):
                out[f"n_tokens_{i}"] = [count_tokens(x, name, folder) for x in b[text]]
            yield out

    fields = [f"`{c}` {t}" for c, t in df.dtypes if c != text]
    return df.mapInPandas(count, ", ".join(fields + [f"n_tokens_{i} long" for i in range(len(names))]))
