"""Ids of a byte-level vocabulary, by the fastest installed encoder that gives the same ids as the vocabulary's own library."""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import tiktoken

from corpusloom.llm.bpe_prefix import PrefixBpe, load


class ByteIds:
    """Ids as 32-bit arrays. The vocabulary's ids are its merge order, so they are the ranks of tokens."""

    def __init__(self, path: str):
        self.exact: PrefixBpe = load(path)
        added = set(self.exact.added.values())
        ranks = {raw: i for i, raw in enumerate(self.exact.token_bytes) if i not in added}
        built = [self.exact.by_bytes[self.exact.token_bytes[a] + self.exact.token_bytes[b]] for a, b in sorted(self.exact.rank, key=self.exact.rank.get)]
        if built != sorted(built):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.exact.added)

    def ids(self, text: str) -> np.ndarray:
        """The strings of added tokens give their own ids."""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of white space that is too long for its matcher
            return np.frombuffer(self.exact.encode_to_bytes(text), np.uint32)

    def plain(self, text: str) -> np.ndarray:
        """The strings of added tokens are text like any other."""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:
            return np.frombuffer(self.exact._plain(text), np.uint32)


@functools.lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)
