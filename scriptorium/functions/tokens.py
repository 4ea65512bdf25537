"""Token counts under a public byte-level vocabulary, for chunking and budgets."""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import cache

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Counts tokens of texts; the rank file (under a megabyte) is read on the driver and travels with the counter."""

    def __init__(self, folder: str = FOLDER, name: str = NAME):
        with open(f"{folder}/{name}", "rb") as file:
            self.lines = file.read()

    def __call__(self, text: str) -> int:
        return len(_encoding(self.lines).encode_ordinary(text))

    def ruler(self, text: str) -> Ruler:
        """Positions of the tokens of a whole text, on which its stretches are measured."""
        encoding = _encoding(self.lines)
        at, starts = 0, []
        for token in encoding.encode_ordinary(text):
            starts.append(at)
            at += sum(b & 0xC0 != 0x80 for b in encoding.decode_single_token_bytes(token))  # characters that begin in it
        return Ruler(starts)


class Characters:
    """Counts characters as if they were tokens; for texts of which no vocabulary is known."""

    def __call__(self, text: str) -> int:
        return len(text)

    def ruler(self, text: str) -> Ruler:
        return Ruler(range(len(text)))


class Ruler:
    """Token lengths of stretches of one text: a token belongs to the stretch in which it starts."""

    def __init__(self, starts):
        self.starts = starts

    def count(self, start: int, end: int) -> int:
        return bisect_left(self.starts, end) - bisect_left(self.starts, start)

    def longest(self, start: int, size: int, limit: int) -> int:
        """The greatest end such that text[start:end] has at most ``limit`` tokens, at most ``size``; one character at least."""
        i = bisect_left(self.starts, start) + limit
        return max(min(self.starts[i] if i < len(self.starts) else size, size), start + 1)
