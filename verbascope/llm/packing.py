"""Filling containers of one capacity with whole texts that belong together.

Texts are routed to shards of bounded bytes within their language, by a signature of their rarer terms, so
that texts with terms in common meet. In each shard a BM25 inverted index answers, for a seed text, which
unused texts are closest to it; the seed's container is filled with them in that order as far as they fit. The
gap that no neighbour fits is filled by one or two unused texts of exactly its size, or else by the longest
that fit. The texts of containers that a shard leaves with much room are packed once more in the same way,
across shards.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import counted_side, materialise
from ..plans.spread import spread
from .bpe import TOKENIZER_FOLDER
from .budget import counter

#: Texts of a shard, and the bytes of their terms, four each, on average at most; a shard's index is held by one task.
SHARD_TEXTS, SHARD_BYTES = 4096, 16 << 20
#: A container filled less than this is packed again with others of its kind.
WELL_FILLED = 0.95
#: Hash classes of terms whose texts are counted, so that routing knows which terms are rare.
ROUTING_CLASSES = 1 << 16
#: Bits of a signature at most.
MOST_BITS = 30
K1, B = 1.5, 0.75


def terms_of(text: str) -> list[str]:
    """Words in lower case; runs of scripts that are written without blanks as overlapping pairs of characters."""
    import re

    terms = []
    for word in re.findall(r"\w+", text.lower()):
        if len(word) > 1 and word[0] > "෿" and not "가" <= word[0] <= "힣":
            terms += [word[i : i + 2] for i in range(len(word) - 1)]
        else:
            terms.append(word)
    return terms


def term_hashes(text: str):
    """The terms of a text, repeated ones too, as 32 bits each."""
    import zlib

    import numpy as np

    crc = np.array([zlib.crc32(t.encode()) for t in terms_of(text)], np.uint64)
    return (crc * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Index:
    """A BM25 inverted index whose postings hold their finished weights, of texts as arrays of term hashes."""

    def __init__(self, bags: list):
        import numpy as np

        self.n = n = len(bags)
        length = np.array([len(b) for b in bags], float)
        names, number = np.unique(np.concatenate([np.asarray(b, np.int32) for b in bags] or [np.zeros(0, np.int32)]), return_inverse=True)
        pairs, count = np.unique(number.astype(np.int64) * n + np.repeat(np.arange(n), length.astype(int)), return_counts=True)
        term, self.documents = np.divmod(pairs, max(n, 1))
        found = np.bincount(term, minlength=len(names))
        self.starts = np.concatenate([[0], np.cumsum(found)])
        rarity = np.log(1 + (n - found + 0.5) / (found + 0.5))
        scale = K1 * (1 - B + B * length / max(length.mean() if n else 0, 1))
        self.weights = rarity[term] * count * (K1 + 1) / (count + scale[self.documents])
        by_text = np.argsort(self.documents, kind="stable")
        self.terms, self.text_starts = term[by_text], np.concatenate([[0], np.cumsum(np.bincount(self.documents, minlength=n))])

    def scores(self, seed: int):
        """The similarity of every text to text `seed`."""
        import numpy as np

        terms = self.terms[self.text_starts[seed] : self.text_starts[seed + 1]]
        lengths = self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(lengths)
        postings = np.repeat(self.starts[terms] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.documents[postings], self.weights[postings], self.n)


class Unused:
    """The items not yet placed, by size."""

    def __init__(self, sizes: list[int], capacity: int):
        import numpy as np

        self.sizes, self.count = sizes, np.bincount(np.array(sizes, int), minlength=capacity + 1)
        self.free = np.ones(len(sizes), bool)
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in reversed(range(len(sizes))):
            self.items[sizes[i]].append(i)

    def take(self, i: int) -> int:
        self.free[i] = False
        self.count[self.sizes[i]] -= 1
        return i

    def put_back(self, i: int) -> None:
        self.free[i] = True
        self.count[self.sizes[i]] += 1

    def of_size(self, size: int) -> int:
        own = self.items[size]
        while not self.free[own[-1]]:
            own.pop()
        return self.take(own.pop())

    def longest(self, room: int) -> int:
        """The greatest size that fits; 0 if none does."""
        import numpy as np

        there = np.flatnonzero(self.count[: room + 1])
        return int(there[-1]) if len(there) else 0

    def exact(self, room: int) -> list[int]:
        """One size, or two, that fill `room` to the last token; none if there are none."""
        import numpy as np

        if self.count[room]:
            return [room]
        small = np.flatnonzero(self.count[: room // 2 + 1])
        small = small[self.count[room - small] > (2 * small == room)]
        return [int(small[-1]), room - int(small[-1])] if len(small) else []


def fill(sizes: list[int], bags: list | None, capacity: int) -> list[list[tuple[int, str, int | None]]]:
    """Containers as lists of (item, how it was placed, rank); every item of a size from 1 to `capacity` once.

    The longest unused item is the `seed`; its `neighbour`s follow in order of their likeness, each with its rank among
    the unused items that share a term with the seed and fit beside it; a `gap` is filled by size. bags: the items' term hashes; without them, by size alone.
    """
    import numpy as np

    unused, size = Unused(sizes, capacity), np.array(sizes, int)
    index = Index(bags) if bags is not None else None
    containers = []
    while seed_size := unused.longest(capacity):
        seed, room = unused.of_size(seed_size), capacity - seed_size
        own: list[tuple[int, str, int | None]] = [(seed, "seed", None)]
        if index is not None and room:
            scores = index.scores(seed)
            near = np.flatnonzero(unused.free & (size <= room) & (scores > 0))
            for rank, i in enumerate(near[np.argsort(-scores[near], kind="stable")].tolist(), 1):
                if sizes[i] <= room:
                    own.append((unused.take(i), "neighbour", rank))
                    room -= sizes[i]
                    if not room:
                        break
        while room:
            chosen = unused.exact(room) or [unused.longest(room)]
            if not chosen[0]:
                break
            own += [(unused.of_size(n), "gap", None) for n in chosen]
            room -= sum(chosen)
        containers.append(own)
    return containers


def signatures(bags: list, rarity):
    """MOST_BITS bits of each text, which texts with the same rare terms tend to share: each is the side on which the sum of the distinct terms' hashes, weighted by rarity, lies; as the place in a Gray code, so that neighbours differ in one bit. 0 without terms."""
    import numpy as np

    own = np.repeat(np.arange(len(bags)), np.array([len(b) for b in bags], int))
    hashes = np.concatenate([*map(np.sort, bags), np.zeros(0, np.int32)])
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])])[: len(hashes)]
    hashes, found = hashes[new].view(np.uint32).astype(np.int64), np.bincount(own[new], minlength=len(bags))
    ends = np.cumsum(found)
    starts = ends - found
    weights = rarity[hashes % ROUTING_CLASSES]
    places, bit = np.zeros(len(bags), np.int64), np.zeros(len(bags), bool)
    for k in range(MOST_BITS):
        sums = np.concatenate([[0], np.cumsum(np.where(hashes >> k & 1, weights, -weights))])
        bit ^= sums[ends] - sums[starts] > 1e-9
        places = places << 1 | bit
    return places


def bags_in(terms) -> list:
    """The arrays of an Arrow array of lists without nulls."""
    import numpy as np

    ends = np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(terms.flatten().to_numpy(), ends[:-1]) if len(terms) else []


def term_rarity(df: DataFrame):
    """The weight of each hash class of terms, by how few of all texts that have terms have one of it: log(n / found).

    df: the texts, or what `with_size` made of them, so that no text is hashed again.
    """
    import numpy as np

    hashed = "terms" in df.columns

    def batches(source: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found = np.zeros(ROUTING_CLASSES + 1, np.int64)  # the last place counts the texts
        for batch in source:
            for bag in bags_in(batch.column(0)) if hashed else map(term_hashes, batch.column(0).to_pylist()):
                found[bag.view(np.uint32) % ROUTING_CLASSES] += 1  # once, even if the class is there twice
                found[-1] += len(bag) > 0
        places = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found[places])], names=["place", "found"])

    column = "terms" if hashed else "text"
    counted = df.where(F.col(column).isNotNull()).select(column).mapInArrow(batches, "place bigint, found bigint")
    found = np.zeros(ROUTING_CLASSES + 1)
    for r in counted.groupBy("place").agg(F.sum("found").alias("found")).collect():  # a number a class at most
        found[r.place] = r.found
    return np.log((found[-1] + 1) / (found[:-1] + 1))


def with_size(df: DataFrame, name: str, folder: str, rarity=None) -> DataFrame:
    """(key, group, digest, n_tokens, terms) of (key, group, text), in one narrow pass; no text leaves it. With `signature` if the rarity of terms is given."""

    def batches(source: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        count = counter(name, folder)
        for batch in source:
            texts = batch.column(3).to_pylist()
            n = pa.array([count(t) if t else 0 for t in texts], pa.int64())
            bags = [term_hashes(t or "") for t in texts]
            ends = pa.array(np.cumsum([0, *map(len, bags)]), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*bags, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, terms], names=["key", "group", "digest", "n_tokens", "terms"])

    kind = df.schema["key"].dataType.simpleString()
    sized = df.select("key", "group", F.xxhash64("text").alias("digest"), "text").mapInArrow(batches, f"key {kind}, group string, digest bigint, n_tokens bigint, terms array<int>")
    return sized if rarity is None else with_signature(sized, rarity)


def with_signature(sized: DataFrame, rarity) -> DataFrame:
    """`sized` with `signature`, made anew wherever it is read, so that the terms are not stored twice."""
    shared = sized.sparkSession.sparkContext.broadcast(rarity)

    def signature(terms):
        import pyarrow as pa

        return pa.array(signatures(bags_in(terms), shared.value))

    # Said to be nondeterministic so that no filter is pushed below it, which would make it twice.
    return sized.withColumn("signature", F.arrow_udf(signature, "bigint").asNondeterministic()("terms"))


def routed(sized: DataFrame, shard_texts: int, shard_bytes: int) -> DataFrame:
    """`sized` with `shard`: each group cut along its signatures into parts of about the bounds.

    Texts are summed up by group and leading bits of the signature, as many bits as make a few classes a shard; classes
    follow each other into a shard until it is full, and a class beyond a shard's bounds is split by the hash of its keys.
    """
    weight = F.greatest(F.count(F.lit(1)) / shard_texts, F.sum(4 * F.size("terms")) / shard_bytes)
    whole = sized.agg(weight).first()[0] or 0
    bits = min(MOST_BITS, max(2, int(4 * whole).bit_length()))
    cut = F.shiftright("signature", MOST_BITS - bits)
    cells = sized.groupBy("group", cut.alias("cell")).agg(weight.alias("weight"))
    before = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    total = F.sum("weight").over(Window.partitionBy("group"))
    step = total / F.ceil(total)  # equal parts, each within the bounds on average
    split = F.greatest(F.lit(1), F.ceil("weight")).cast("bigint")
    placed, _ = counted_side(cells.select("group", "cell", F.when(split > 1, F.concat_ws(".", F.lit("c"), "cell")).otherwise(F.floor((F.col("before") + F.col("weight") / 2) / step).cast("string")).alias("part"), split.alias("split")), 100_000)
    joined = sized.withColumn("cell", cut).join(placed, ["group", "cell"])
    return joined.withColumn("shard", F.concat_ws(":", "group", "part", F.when(F.col("split") > 1, F.pmod(F.xxhash64("key"), F.col("split"))))).drop("cell", "part", "split")


def pack(df: DataFrame, key: str, group: str, text: str, capacity: int, name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER, shard_texts: int = SHARD_TEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(container, key, piece, first_token, n_tokens, placed, rank): where each text of `df` lies and why.

    A text of more tokens than `capacity` fills containers of its own with its first pieces (placed `whole`); its
    last piece is packed like a text: as a `seed`, a `neighbour` of its seed with a rank, or in a `gap`. Null and
    empty texts have no tokens and a null container. `group` keeps texts of a language together; null is a group.
    Every row of `df` comes out, repeated ones as often as they occur.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("key"), F.coalesce(F.col(group), F.lit("")).alias("group"), F.col(text).alias("text")), "key")
    sized = materialise(with_size(rows, name, folder))
    sized = with_signature(sized, term_rarity(sized))
    schema = f"container string, key {kind}, piece int, first_token bigint, n_tokens bigint, placed string, rank int, terms array<int>"
    columns = ["container", "key", "piece", "first_token", "n_tokens", "placed", "rank"]

    def shard(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["key", "n_tokens", "digest"]).reset_index(drop=True)
        own, keys, sizes, bags = pdf["shard"].iloc[0], pdf["key"].tolist(), pdf["n_tokens"].tolist(), pdf["terms"].tolist()
        rows, items = [], []
        for i, n in enumerate(sizes):
            if n == 0:
                rows.append((None, keys[i], 0, 0, 0, None, None, None))
            whole = n // capacity
            rows += [(f"{own}/{i}.{p}", keys[i], p, p * capacity, capacity, "whole", None, None) for p in range(whole)]
            if n % capacity:
                items.append((i, whole, n % capacity))
        for c, members in enumerate(fill([n for _, _, n in items], [bags[i] for i, _, _ in items], capacity)):
            poor = sum(items[m][2] for m, _, _ in members) < WELL_FILLED * capacity
            rows += [(f"{own}/{c}", keys[i], p, p * capacity, n, how, rank, bags[i] if poor else None) for (i, p, n), how, rank in ((items[m], how, rank) for m, how, rank in members)]
        return pd.DataFrame(rows, columns=[*columns, "terms"], dtype=object)

    first = materialise(routed(sized, shard_texts, shard_bytes).select("shard", "key", "digest", "n_tokens", "terms").groupBy("shard").applyInPandas(shard, schema))

    def again(pdf):
        pdf = pdf.sort_values(["container", "key", "piece", "first_token"]).reset_index(drop=True)
        containers = fill(pdf["n_tokens"].tolist(), pdf["terms"].tolist(), capacity)
        if len(containers) < pdf["container"].nunique():
            names = pdf["container"].tolist()
            new = {m: (f"{names[members[0][0]]}+{number}", how, rank) for number, members in enumerate(containers) for m, how, rank in members}
            for k, column in enumerate(("container", "placed", "rank")):
                pdf[column] = pd_object([new[m][k] for m in range(len(pdf))])
        return pdf[columns]

    # Poor containers are few, about one a shard; they meet in parts of bounded size.
    poor = first.where("terms is not null")
    left = poor.agg(F.count(F.lit(1)) / shard_texts, F.sum(4 * F.size("terms")) / shard_bytes).first()
    parts = max(1, -int(-max(left[0] or 0, left[1] or 0) // 1))
    moved = poor.withColumn("part", F.pmod(F.xxhash64("container"), F.lit(parts))).groupBy("part").applyInPandas(again, ", ".join(schema.split(", ")[:-1]))
    return first.where("terms is null").select(*columns).unionByName(moved).withColumnRenamed("key", key)


def pd_object(values: list):
    """A column of Python values, nulls among them."""
    import pandas as pd

    return pd.Series(values, dtype=object)
