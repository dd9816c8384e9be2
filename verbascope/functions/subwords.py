"""Public tokenisers by the name of their vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

#: Where the vocabulary files lie, unless a caller names another folder.
TOKENIZER_FOLDER = os.environ.get("VERBASCOPE_TOKENIZERS", "/opt/tokenizers")
#: The pattern, published with the byte-level vocabularies, that splits text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokeniser(name: str, folder: str = TOKENIZER_FOLDER) -> Callable[[str], list[int]]:
    """A function that gives the token ids of a text, without special tokens."""
    if name.startswith("byte_bpe"):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if name.startswith("piece_bpe"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
        return lambda text: pieces.encode(text, num_threads=1)
    import tokenizers

    other = tokenizers.Tokenizer.from_file(f"{folder}/{name}.json")
    other.encode_special_tokens = True
    return lambda text: other.encode(text, add_special_tokens=False).ids


def counter(name: str, folder: str = TOKENIZER_FOLDER) -> Callable[[str], int]:
    """A function that counts the tokens of a text, without special tokens."""
    ids = tokeniser(name, folder)
    return lambda text: len(ids(text))
