"""Token IDs of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

#: The vocabulary file; a parameter of all that use it. Only the driver opens it, tasks get its bytes (half a MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a text that are tokenised at once: longer texts are cut at white space before a word.
PIECE = 200_000


def vocabulary(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(data: bytes):
    """The encoding of a vocabulary file's bytes, and the first ID that it leaves free."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("citegrid", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that have the tokens of the whole: they are cut before a space that follows a non-space."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and text[cut - 1].isspace():
            cut -= 1
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count(text: str, data: bytes) -> int:
    encode = encoding(data)[0].encode_ordinary
    return sum(len(encode(p)) for p in pieces(text))
