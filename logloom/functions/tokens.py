"""A public tokenizer with character offsets, for labelling and round trips."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The installed vocabulary file ``name``; LOGLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("LOGLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class OffsetTokenizer:
    """Ids of texts with the characters that each stands for, by one vocabulary file of ranks.

    Marks of the chat format are encoded as the text they are.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and their characters (from, to); a token that holds part of a character has the whole one."""
        ids = self.own.encode_ordinary(text)
        if not ids:
            return [], []
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(b) for b in self.own.decode_tokens_bytes(ids)])
        starts = np.concatenate([[0], ends[:-1]])
        return ids, list(zip(character[starts].tolist(), (character[ends - 1] + 1).tolist(), strict=True))

    def decode(self, ids: list[int]) -> str:
        return self.own.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def offset_tokenizer(path: str) -> OffsetTokenizer:
    return OffsetTokenizer(path)


def public_tokenizer(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """The default tokenizer, read once a worker."""
    return offset_tokenizer(tokenizer_path())(text)
