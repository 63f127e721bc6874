"""Public tokenizer files, loaded once per Python worker. Paths are parameters."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from pathlib import Path

import numpy as np


def resolve(path: str) -> str:
    """A tokenizer file: a path, or a file's name in the installed collection of public tokenizers."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizers-library tokenizer of a json file; special tokens' strings in texts are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(resolve(path))
    loaded.encode_special_tokens = True
    return loaded


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file."""
    lines = map(bytes.split, Path(resolve(path)).read_bytes().splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The tiktoken encoding of a rank file."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks(path), special_tokens={})


def encode_words(path: str, words: list[bytes], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(ids per word, all ids) of chunks encoded one by one by the tokenizers library."""
    coder = tokenizer(path)
    counts, ids = [], []
    for i in range(0, len(words), step):
        part = [w.decode() for w in words[i:i + step]]
        done = coder.encode(part, is_pretokenized=True, add_special_tokens=False)
        counts.append(np.bincount(np.array(done.word_ids, np.int64), minlength=len(part)))
        ids.append(np.array(done.ids, np.uint32))
    return np.concatenate(counts), np.concatenate(ids)
