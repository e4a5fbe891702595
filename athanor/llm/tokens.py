"""Token ids of texts by a public vocabulary whose file path is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np

@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _added(path: str) -> tuple[str, ...]:
    """The tokens that the tokenizer finds in a text before its vocabulary is applied."""
    return tuple(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


@cache
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _has_long_run(text: str, size: int = 2000) -> bool:
    """Whether a stretch of `size` characters has no white space, or nothing else; a run of twice that has one."""
    if len(text) < 2 * size:
        return False
    for at in range(0, len(text), size):
        if text.find(" ", at, at + size) < 0 or text[at : at + size].isspace():
            return True
    return False


def encode(text: str, path: str) -> list[int]:
    """The tokenizer's ids of `text`, without special tokens added.  Where the vocabulary also lies there as ranks
    they are used, since they give the same ids several times faster; texts with very long unbroken runs, and
    those that hold one of the tokenizer's added tokens, go to the tokenizer itself."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks) and not any(x in text for x in _added(path)) and not _has_long_run(text):
        return _ranks(ranks).encode_ordinary(text)
    return _tokenizer(path).encode(text, add_special_tokens=False).ids


def encode_document(text: str | None, path: str, end: int, kind: str = "<u4") -> np.ndarray:
    """The ids of a document and its end id; null text counts as empty."""
    return np.array([*encode(text, path), end] if text else [end], dtype=kind)


def id_kind(path: str) -> str:
    """The narrowest unsigned little-endian type of the vocabulary's ids."""
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
