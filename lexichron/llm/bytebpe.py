"""Byte-level BPE by a public vocabulary: ids as the tokenizers library gives them, made by the faster of two libraries.

The vocabulary's ids are in the order of its merges, so that it serves as ranks too. Where the rank library gives up (runs of
white space beyond its stack) or a text holds a special token's string that counts as one, the tokenizers library encodes.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .bpe import byte_letters

#: Fixed value: the published pattern that cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Encodes texts; special says whether special tokens' strings inside a text are special tokens or plain text."""

    def __init__(self, spec: str, special: bool):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(spec)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = {bytes([byte_of[x] for x in name]): i for name, i in model["model"]["vocab"].items()}
        self.slow = Tokenizer.from_str(spec)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = not special
        self.marks = [t["content"] for t in model["added_tokens"]] if special else []
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.size = max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1
        self.bytes_of = [b""] * self.size
        for raw, i in vocab.items():
            self.bytes_of[i] = raw

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        if not any(m in text for m in self.marks):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run of white space too long for its regular expressions
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(spec: str, special: bool) -> ByteBpe:
    return ByteBpe(spec, special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
