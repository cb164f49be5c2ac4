"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from functools import lru_cache

assert array("I").itemsize == 4 and sys.byteorder == "little"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a `tokenizers` file and their ids: they stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if odd := [x["content"] for x in found if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]:
        raise ValueError(f"added tokens that take in or depend on what is beside them: {odd}")
    return tuple((x["content"], x["id"]) for x in found)


#: Runs of white space from this length on are too long for the library's own splitting, which keeps a state for each character.
LONG_SPACE = 10_000


class TextEncoder:
    """Maps texts to their ids as little-endian unsigned 32-bit integers, by a file of base64 tokens and ranks and by added tokens.

    A text is split at added tokens first (the longest of those that begin at one place), and what lies between is encoded on its own; other
    special tokens are ordinary text.
    """

    def __init__(self, path: str, added: tuple[tuple[str, int], ...] = ()):
        import public_tokenizers
        import regex
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
        self.words = regex.compile(white_space_of_unicode(public_tokenizers.PATTERN)).findall
        self.long_space = re.compile(r"\s{%d}" % LONG_SPACE).search
        self.added = {content: array("I", [number]).tobytes() for content, number in added}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None

    def encode(self, text: str) -> bytes:
        if not self.splits or not any(x in text for x in self.added):
            return self._between(text)
        return b"".join(self.added[x] if k % 2 else self._between(x) for k, x in enumerate(self.splits(text)))

    def _between(self, text: str) -> bytes:
        if len(text) > LONG_SPACE and self.long_space(text):
            return b"".join(array("I", self.library._core_bpe.encode_single_piece(w.encode())).tobytes() for w in self.words(text))
        return array("I", self.library.encode_ordinary(text)).tobytes()


def white_space_of_unicode(pattern: str) -> str:
    """A pattern for the regex module whose white space is Unicode's, without the control characters that Python counts as such."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@lru_cache(maxsize=2)
def worker_encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> TextEncoder:
    """The encoder that a Python worker keeps from task to task."""
    return TextEncoder(path, added)
