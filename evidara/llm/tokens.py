"""Texts measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import cache
from pathlib import Path

#: Where the vocabulary files lie; a parameter of the environment.
FOLDER = os.environ.get("EVIDARA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that byte-level BPE of this family splits words with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None):  # noqa: ANN201
    """The tokenizer of a rank file, loaded once in a process."""
    import tiktoken

    with Path(folder or FOLDER, name).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of ``text``: one, unless it alone exceeds ``limit`` tokens.

    Pieces end between characters, follow each other without gap and are as long as the limit lets them be, counted on
    the piece itself. An empty text is one piece of 0 tokens. If one character needs more than ``limit`` tokens, it is a
    piece by itself.
    """
    enc = encoding()
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids))]
    out, start = [], 0
    while start < len(text):
        rest = enc.encode_ordinary(text[start : start + 16 * limit])
        take = min(limit, len(rest))
        while True:
            end = start + max(1, len(enc.decode_bytes(rest[:take]).decode("utf-8", "ignore")))
            count = len(enc.encode_ordinary(text[start:end]))
            if count <= limit or end == start + 1:
                break
            take -= count - limit
        out.append((start, end, count))
        start = end
    return out
