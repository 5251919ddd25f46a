"""The byte-level tokenizer and the piece tokenizer, as functions of single texts. Models are opened once a task."""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_MODEL = "byte_bpe_50k"
#: Fixed value: the vocabulary's special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: A run of white space that is too long for the faster library's recursion.
_LONG_GAP = re.compile(r"\s{10000}")


class ByteEncoder:
    """Ids of a text by the byte-level vocabulary, as `tokenizers` gives them with add_special_tokens=False.

    The same vocabulary as ranks is several times faster in `tiktoken`; both give the same ids (a test compares them), so
    that is what runs, but for texts with very long white space. plain: special tokens' strings are ordinary text.
    """

    def __init__(self, model: str = BYTE_MODEL, plain: bool = False):
        self.model, self.plain, self.slow = model, plain, None
        with open(public_tokenizers.path(f"{model}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(model, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={} if plain else {SPECIAL: SPECIAL_ID})

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < 10000 or not _LONG_GAP.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        if self.slow is None:
            self.slow = Tokenizer.from_file(public_tokenizers.path(f"{self.model}.json"))
            self.slow.encode_special_tokens = self.plain
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out
