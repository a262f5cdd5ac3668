"""Token counts by a public byte-level tokenizer, whose vocabulary file's folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the tokenizer cuts a text before it merges bytes.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def tokenizer(file: str = VOCABULARY, folder: str = TOKENIZER_DIR):
    """The tokenizer of a vocabulary file."""
    import tiktoken

    with open(f"{folder}/{file}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(file, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_length(file: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> Callable[[str], int]:
    """A function that counts a text's tokens; to be given to the splitters."""

    def length(text: str) -> int:
        return len(tokenizer(file, folder).encode_ordinary(text))

    return length
