"""Paired effects, bootstrap, random-effects pooling and rank correlation as aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

#: Normal quantile of 95 % intervals, and least variance of an effect.
Z, LEAST_VARIANCE = 1.96, 1e-12


def hash_number(*parts: Column) -> Column:
    """A number below 2^32 that depends on `parts` alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint")


#: Pairs of resample and draw that are hashed at a time, and draws of one piece of work, about.
HASHED_PAIRS, PIECE_DRAWS = 16_384, 1_000_000


def hashed_pairs(prefix: bytes, first, second):
    """`hash_number` of prefix, and each of `first` with each of `second` behind it, all parted by colons, as an array of rows of `first`.

    first, second: arrays of whole numbers above 0, each of numbers of the same count of digits. The 64 steps of
    MD5 are made for all pairs at once; where a text is too long for one block, one by one.
    """
    import hashlib

    import numpy as np

    parts = [f"{prefix.decode()}:", first, ":", second]
    width = lambda x: len(x.encode()) if isinstance(x, str) else len(str(x[0]))
    length = sum(map(width, parts))
    if length > 55:
        number = lambda a, b: int(hashlib.md5(f"{prefix.decode()}:{a}:{b}".encode()).hexdigest()[:8], 16)
        return np.array([[number(a, b) for b in second.tolist()] for a in first.tolist()], np.int64)
    octets: list = []
    for part in parts:
        if isinstance(part, str):
            octets += [np.full((1, 1), x, np.uint32) for x in part.encode()]
        else:
            own = part.reshape((-1, 1) if part is first else (1, -1))
            octets += [(own // 10**k % 10 + 48).astype(np.uint32) for k in range(width(part) - 1, -1, -1)]
    end = [128, *[0] * (55 - length), *(8 * length).to_bytes(8, "little")]
    octets += [np.full((1, 1), x, np.uint32) for x in end]
    words = [octets[i] | octets[i + 1] << 8 | octets[i + 2] << 16 | octets[i + 3] << 24 for i in range(0, 64, 4)]
    start = [np.full((1, 1), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        kind = i // 16
        f = (d ^ (b & (c ^ d))) if kind == 0 else (c ^ (d & (b ^ c))) if kind == 1 else (b ^ c ^ d) if kind == 2 else (c ^ (b | ~d))
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f = f + a + (word + np.uint32(int(abs(math.sin(i + 1)) * 2**32)))
        turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[kind][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return np.broadcast_to((start[0] + a).byteswap(), (len(first), len(second))).astype(np.int64)


def draws(sizes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(lang, b, draw, i): in each of `resamples`, n draws with replacement of positions below n; sizes: (lang, n).

    A draw is `hash_number` of seed, language, resample and draw, by n. The work is cut into pieces of about
    PIECE_DRAWS, which all cores share whatever the sizes of the languages.
    """
    session = sizes.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    step = F.greatest(F.lit(1), F.lit(PIECE_DRAWS) / F.col("n")).cast("int")
    pieces = sizes.where("n > 0").select("lang", F.col("n").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(resamples), step)).alias("first"), step.alias("step"))

    def batches(source):
        import numpy as np
        import pyarrow as pa

        def classes(low, high):
            """From low to high in arrays of numbers of the same count of digits."""
            while low < high:
                until = min(high, 10 ** len(str(low)))
                yield np.arange(low, until)
                low = until

        for batch in source:
            for lang, n, first, step in zip(*(c.to_pylist() for c in batch.columns)):
                for own in classes(first, min(first + step, resamples + 1)):
                    for drawn in classes(1, n + 1):
                        wide = min(len(drawn), HASHED_PAIRS)
                        high = max(1, HASHED_PAIRS // wide)
                        for i in range(0, len(own), high):
                            for j in range(0, len(drawn), wide):
                                b, draw = own[i : i + high], drawn[j : j + wide]
                                numbers = hashed_pairs(f"{seed}:{lang}".encode(), b, draw).reshape(-1) % n
                                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(numbers)), pa.array(np.repeat(b, len(draw))), pa.array(np.tile(draw, len(b))), pa.array(numbers)], names=["lang", "b", "draw", "i"])

    return pieces.repartition(tasks).mapInArrow(batches, "lang string, b bigint, draw bigint, i bigint")


#: Weights that one hash gives, each by 16 of its bits, and the bits' values from which on a Poisson weight of mean 1 is at least 1, 2, ...
WEIGHTS_PER_HASH = 8
WEIGHT_STEPS = [s for k in range(9) if (s := math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) < 65535]


def bootstrap_means(differences: DataFrame, by: list[str], key: list[str], resamples: int, seed: int) -> DataFrame:
    """(*by, b, mean): the group's mean under each of `resamples` hashed weightings.

    differences: (*by, *key, diff), diff to 6 places. In a resample every row has a Poisson weight of mean 1 that
    depends on nothing but seed, group, key and resample. So a resample is a pair of sums, merged by map task
    before the shuffle: no group is numbered, joined or gathered, however many rows it has. Sums are of whole
    numbers and thus the same in any order. A resample without weight has no mean.
    """
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*by, *key)), F.col("block").cast("string")))
    blocks = -(-resamples // WEIGHTS_PER_HASH)
    session = differences.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = differences.where("diff is not null").select(*by, F.round(F.col("diff") * 1e6).cast("bigint").alias("d"), *key).repartition(parts, *by, *key)  # few bytes, much work a row
    hashed = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hashed = hashed.select(*by, "d", "block", lot.alias("lot"))
    bits = F.posexplode(F.array(*(F.substring("lot", 1 + 4 * j, 4) for j in range(WEIGHTS_PER_HASH)))).alias("j", "bits")
    each = hashed.select(*by, "d", "block", bits).select(*by, "d", (F.col("block") * WEIGHTS_PER_HASH + F.col("j") + 1).alias("b"), "bits")
    steps = [f"{s:04x}" for s in WEIGHT_STEPS]  # hexadecimal digits of one length have the order of their numbers
    weight = reduce(lambda found, k: found.when(F.col("bits") < steps[k], k), range(1, len(steps)), F.when(F.col("bits") < steps[0], 0)).otherwise(len(steps))
    weighed = each.select(*by, "d", "b", weight.cast("bigint").alias("w")).where("w > 0")
    sums = weighed.groupBy(*by, "b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("d")).alias("s"))
    return sums.where(F.col("b") <= resamples).select(*by, "b", (F.col("s") / 1e6 / F.col("n")).alias("mean"))


def paired_bootstrap(differences: DataFrame, by: list[str], key: list[str], resamples: int = 10_000, seed: int = 20250317) -> DataFrame:
    """(*by, n, mean_diff, ci95_low, ci95_high, boot_se, excludes_zero), 6 places."""
    means = bootstrap_means(differences, by, key, resamples, seed).groupBy(*by).agg(
        F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.stddev_samp("mean").alias("se")
    )
    own = differences.where("diff is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"))
    low, high = rounded(F.col("ci")[0], 6), rounded(F.col("ci")[1], 6)
    return own.join(means, by).select(*by, "n", rounded("mean", 6).alias("mean_diff"), low.alias("ci95_low"), high.alias("ci95_high"), rounded("se", 6).alias("boot_se"), ((low > 0) | (high < 0)).alias("excludes_zero"))


def random_effects(effects: DataFrame, by: list[str]) -> DataFrame:
    """(*by, k, pooled_effect, se, ci95_low, ci95_high, tau2, q, df, i2) of effects (y, se), by the method of moments; 6 places."""
    weighed = effects.withColumn("v", F.greatest(F.col("se") * F.col("se"), F.lit(LEAST_VARIANCE))).withColumn("w", 1.0 / F.col("v"))
    fixed = weighed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")
    )
    spread = weighed.join(fixed, by).groupBy(*by, "k", "sw", "sw2").agg(F.sum(F.col("w") * F.pow(F.col("y") - F.col("mean"), 2)).alias("q"))
    c, df = F.col("sw") - F.col("sw2") / F.col("sw"), (F.col("k") - 1).cast("double")
    moments = spread.withColumn("df", df).withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / c)).otherwise(0.0))
    again = weighed.join(moments, by).withColumn("wr", 1.0 / (F.col("v") + F.col("tau2")))
    pooled = again.groupBy(*by, "k", "q", "df", "tau2").agg((F.sum(F.col("wr") * F.col("y")) / F.sum("wr")).alias("m"), F.sqrt(1.0 / F.sum("wr")).alias("s"))
    r = lambda x: rounded(x, 6)
    return pooled.select(
        *by,
        "k",
        r(F.col("m")).alias("pooled_effect"),
        r(F.col("s")).alias("se"),
        r(F.col("m") - Z * F.col("s")).alias("ci95_low"),
        r(F.col("m") + Z * F.col("s")).alias("ci95_high"),
        r(F.col("tau2")).alias("tau2"),
        r(F.col("q")).alias("q"),
        F.col("df").cast("bigint").alias("df"),
        r(F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0)).alias("i2"),
    )


def average_rank(column: str, by: list[str]) -> Column:
    """The rank of a value, tied values sharing the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(column)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2.0


def rank_correlations(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(*by, n, rho_<x>_<y>...) of every two columns, over rows that have all of them."""
    whole = df.where(" and ".join(f"{c} is not null" for c in columns))
    ranks = whole.select(*by, *(average_rank(c, by).alias(c) for c in columns))
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.corr(x, y).alias(f"rho_{x}_{y}") for x, y in pairs))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """The correlation of x and y given z; null where z determines one of them."""
    return F.try_divide(rxy - rxz * ryz, F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz)))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a correlation of n > 3 pairs."""
    half = F.when(n > 3, Z / F.sqrt(n - 3.0))
    middle = F.atanh(r)
    return F.tanh(middle - half), F.tanh(middle + half)


def detectable(n: Column) -> Column:
    """The least correlation whose 95 % interval excludes zero with n pairs."""
    return F.tanh(F.when(n > 3, Z / F.sqrt(n - 3.0)))
