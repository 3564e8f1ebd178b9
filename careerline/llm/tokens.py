"""Token ids of whole texts, by the vocabulary of the public byte-level tokenizer."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import cache
from pathlib import Path

#: Id after the last token of every document.
END_OF_DOCUMENT = 2
#: The vocabulary's pattern for texts whose words are one white space apart. Without a look-ahead
#: it runs in linear time, in two thirds of the time of the full pattern.
_PLAIN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_WIDE_SPACE = re.compile(r"\s\s")


class TokenIds:
    """Encodes whole texts with the ranks that lie beside a tokenizer's JSON file.

    The ids are those of the JSON file. Only a text on which the ranks' library gives up (white
    space without end) is encoded by the slower library that reads the JSON file itself.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        lines = Path(vocabulary).with_suffix(".tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": len(ranks)}
        self._vocabulary = vocabulary
        self._plain = tiktoken.Encoding("plain", pat_str=_PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = tiktoken.Encoding(
            "full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def ids(self, text: str) -> list[int]:
        if not _WIDE_SPACE.search(text) and "<|endoftext|>" not in text:
            return self._plain.encode_ordinary(text)
        try:
            return self._full.encode(text, allowed_special="all")
        except ValueError:
            from tokenizers import Tokenizer

            return Tokenizer.from_file(self._vocabulary).encode(text, add_special_tokens=False).ids


@cache
def token_ids(vocabulary: str) -> TokenIds:
    """One encoder per vocabulary and Python worker."""
    return TokenIds(vocabulary)


def document_ids(text: str | None, vocabulary: str) -> array:
    """Little-endian 32-bit ids of a document: its text (NULL: empty), then :data:`END_OF_DOCUMENT`."""
    found = array("I", token_ids(vocabulary).ids(text or ""))
    found.append(END_OF_DOCUMENT)
    if sys.byteorder == "big":
        found.byteswap()
    return found
