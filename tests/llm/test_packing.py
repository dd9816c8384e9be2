import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbascope.llm import packing
from verbascope.llm.bpe import TOKENIZER_FOLDER
from verbascope.llm.budget import counter


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_fill_places_every_item_once(sizes):
    containers = [[i for i, _, _ in c] for c in packing.fill(sizes, None, 50)]
    assert sorted(i for c in containers for i in c) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in c) <= 50 for c in containers)
    # no more containers than first-fit decreasing may need
    assert len(containers) <= 11 / 9 * -(-sum(sizes) // 50) + 6 / 9 + sum(s > 25 for s in sizes)


def test_index_against_the_formula():
    texts = ["red green blue", "red red fish", "blue fish", "", "河流冰川 河流"]
    index = packing.Index([packing.term_hashes(t) for t in texts])
    bags = [packing.terms_of(t) for t in texts]
    mean = sum(map(len, bags)) / len(bags)
    for seed in range(len(texts)):
        expected = np.zeros(len(texts))
        for t in set(bags[seed]):
            found = sum(t in b for b in bags)
            for i, b in enumerate(bags):
                tf = b.count(t)
                expected[i] += np.log(1 + (len(texts) - found + 0.5) / (found + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(b) / mean))
        assert np.allclose(index.scores(seed), expected)


def test_neighbours_share_a_container():
    rng = random.Random(1)
    topics = [[f"{t}word{i}" for i in range(30)] for t in "abcd"]
    texts = [" ".join(rng.choices(topics[i % 4], k=20)) for i in range(200)]
    containers = [[i for i, _, _ in c] for c in packing.fill([20] * 200, [packing.term_hashes(t) for t in texts], 200)]
    pure = sum(len({i % 4 for i in c}) == 1 for c in containers)
    assert len(containers) == 20 and pure >= 17


def test_neighbours_come_in_order():
    """Of the unused texts that fit, the one most like the seed is taken first, and none is passed over."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 25))) for _ in range(150)]
    sizes = [len(t.split()) for t in texts]
    index, left = packing.Index([packing.term_hashes(t) for t in texts]), set(range(150))
    for members in packing.fill(sizes, [packing.term_hashes(t) for t in texts], 60):
        seed = members[0][0]
        assert members[0][1] == "seed" and sizes[seed] == max(sizes[i] for i in left)
        left.discard(seed)
        scores, room = index.scores(seed), 60 - sizes[seed]
        fitting = sorted((i for i in left if scores[i] > 0 and sizes[i] <= room), key=lambda i: (-scores[i], i))
        expected = []
        for rank, i in enumerate(fitting, 1):
            if sizes[i] <= room:
                expected.append((i, "neighbour", rank))
                room -= sizes[i]
        assert [m for m in members if m[1] == "neighbour"] == expected
        left -= {i for i, _, _ in members}
    assert not left


def test_routing(spark):
    rng = random.Random(3)
    topics = [[f"{t}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)] for t in ("ka", "lo", "mi", "ru")]
    common = "the of and to in".split()
    rows = [(i, "en", " ".join(rng.choices(topics[i % 4], k=25) + rng.choices(common, k=15)), 40) for i in range(800)] + [(10_000 + i, "de", "same text", 2) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, group string, text string, n bigint").drop("n")
    rarity = packing.term_rarity(df)
    assert rarity.min() >= 0 and len(set(packing.signatures([packing.term_hashes(t) for t in ("the of", "of the", "of  the of")], rarity).tolist())) == 1 and packing.signatures([packing.term_hashes("")], rarity).tolist() == [0]
    sized = packing.with_size(df, "byte_bpe_50k", TOKENIZER_FOLDER, rarity).cache()
    got = packing.routed(sized, 100, 1 << 20).select("key", "group", "shard").collect()
    assert sorted(r.key for r in got) == sorted(r[0] for r in rows)
    sizes, topic_of = {}, {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.key)
        topic_of.setdefault(r.shard, []).append(r.key % 4)
    assert max(map(len, sizes.values())) <= 250 and all(len({k >= 10_000 for k in v}) == 1 for v in sizes.values())
    pure = sum(max(map(v.count, range(4))) for shard, v in topic_of.items() if shard.startswith("en"))
    assert pure > 0.5 * 800  # a quarter by lot
    by_bytes = packing.routed(sized, 10**6, 2000).groupBy("shard").agg(F.sum(4 * F.size("terms")).alias("n")).collect()
    assert len(by_bytes) > 40 and max(r.n for r in by_bytes) < 12_000


def test_rarity_is_counted_over_all_texts(spark):
    """Many texts, each counted for each of its classes of terms once, whether it is hashed here or was before."""
    texts = [f"common common w{i % 7} once{i if i % 300 == 0 else ''}" for i in range(30_000)] + [""]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(-1, "en", None)], "key bigint, group string, text string")
    found = np.zeros(packing.ROUTING_CLASSES)
    for t in texts:
        found[list({int(h) % packing.ROUTING_CLASSES for h in packing.term_hashes(t).view(np.uint32)})] += 1
    expected = np.log(30_001 / (found + 1))
    assert found.max() == 30_000 and (found == 1).sum() > 90
    assert np.allclose(packing.term_rarity(df), expected)
    assert np.allclose(packing.term_rarity(packing.with_size(df, "byte_bpe_50k", TOKENIZER_FOLDER)), expected)


def test_pack(spark):
    rng = random.Random(2)
    words = "river court striker kernel wage novel atom fever".split()
    rows = [(i, rng.choice(["en", "de", None]), " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(1000, "en", None), (1001, "en", ""), (1002, None, "word " * 1000), (1003, "de", "word " * 128), (7, "en", rows[7][2]), (1004, "en", "x")] + [(None, "en", "null key")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("key", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("n_tokens", F.lit(1))
    got = packing.pack(df, "doc_id", "lang", "text", 128, shard_texts=100).collect()
    count = counter("byte_bpe_50k", TOKENIZER_FOLDER)
    filled, by_key = {}, {}
    for r in got:
        if r.container is None:
            assert r.n_tokens == 0
        else:
            filled[r.container] = filled.get(r.container, 0) + r.n_tokens
        by_key.setdefault(r.doc_id, []).append(r)
    assert max(filled.values()) <= 128
    tokens = {}
    for key, _, text in rows:
        tokens.setdefault(key, []).append(count(text) if text else 0)
    assert {k: sum(r.n_tokens for r in v) for k, v in by_key.items()} == {k: sum(v) for k, v in tokens.items()}
    assert all(len(v) == len(tokens[k]) for k, v in by_key.items() if max(tokens[k]) <= 128)
    pieces = sorted(by_key[1002], key=lambda r: r.piece)
    assert [r.first_token for r in pieces] == [128 * i for i in range(len(pieces))] and all(r.n_tokens == 128 for r in pieces[:-1])
    assert sum(filled.values()) / (128 * len(filled)) > 0.97
    assert packing.pack(df.limit(0), "doc_id", "lang", "text", 128).count() == 0
