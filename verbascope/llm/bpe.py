"""Byte-level BPE encoding with a published vocabulary, and decoding.

Merges are taken from a priority queue of ranks over a doubly linked list of symbols; entries that no longer
describe two neighbours are stale and skipped, so a piece of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.subwords import PIECES, TOKENIZER_FOLDER
from ..plans.spread import spread

#: Distinct pieces whose ids a worker remembers; it forgets them all beyond that.
REMEMBERED = 200_000


class BytePairEncoder:
    """Encodes with the ranks of a `.tiktoken` file."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(PIECES).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        end = len(piece)
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(end)]
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(rank, i, both) for i in range(end - 1) if (rank := rank_of(both := piece[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, left, both = heappop(queue)
            right = after[left]
            if symbols[left] is None or right == end or len(symbols[left]) + len(symbols[right]) != len(both) or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            following = after[left] = after[right]
            if following < end:
                before[following] = left
                joined = both + symbols[following]
                if (rank := rank_of(joined)) is not None:
                    heappush(queue, (rank, left, joined))
            if (preceding := before[left]) >= 0:
                joined = symbols[preceding] + both
                if (rank := rank_of(joined)) is not None:
                    heappush(queue, (rank, preceding, joined))
        return [self.ranks[s] for s in symbols if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for a null or empty text."""
        ids: list[int] = []
        known = self.known
        for piece in self.pieces(text or ""):
            found = known.get(piece)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[piece] = self.merge(piece.encode())
            ids += found
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text whose ids these are."""
        return b"".join(self.tokens[i] for i in ids).decode()


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> BytePairEncoder:
    """One encoder a worker and vocabulary."""
    return BytePairEncoder(f"{folder}/{name}.tiktoken")


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(key, ids) for every row of `df`, repeated ones too; null and empty texts have an empty list.

    One narrow pass, without a shuffle unless there are fewer files than cores, and a batch of texts at a time in a worker.
    """

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(name, folder)
        for batch in source:
            ids, ends = array("i"), array("i", [0])
            for value in batch.column(1):
                ids.extend(own.encode(value.as_py()))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, F.col(text)), key).mapInArrow(batches, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(key, text) from (key, ids); a null list gives a null text."""

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(name, folder)
        for batch in source:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "ids").mapInArrow(batches, f"`{key}` {kind}, text string")
