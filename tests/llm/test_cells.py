import random
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm._frames import cells


def test_even_and_ascending(spark):
    r = random.Random(4)
    sparse = [r.randrange(10**6) for _ in range(3000)] + [2**62, -(2**62)] + [10**15 + i for i in range(3000)]
    hot = [5] * 4000 + list(range(2000))
    for ids in (sparse, hot, [7] * 50, [1], []):
        df = spark.createDataFrame([(i, f"t{k:05d}") for k, i in enumerate(ids)] + [(None, f"x{k:05d}") for k in range(9)], "doc_id long, text string")
        bytes_ = 70 * (len(ids) + 9)
        for n in (1, 5, 64, 3000):
            dealt, total, _ = cells(df, max(70, bytes_ // n))
            got = dealt.select("doc_id", F.xxhash64("text").alias("h"), F.col("cell").alias("c")).collect()
            rows = sorted((g.doc_id is not None, g.doc_id or 0, g.h, g.c) for g in got)
            assert all(0 <= c < total for *_, c in rows) and [c for *_, c in rows] == sorted(c for *_, c in rows)
            if len(ids) > 1000 and n == 64:
                assert max(Counter(c for *_, c in rows).values()) < 4 * len(rows) / n


def test_long_texts_have_cells_of_their_own(spark):
    df = spark.createDataFrame([(i, "x" * (10_000 if i < 20 else 10)) for i in range(1000)], "doc_id long, text string")
    dealt, total, _ = cells(df, 20_000)
    got = dealt.groupBy("cell").agg(F.sum(F.octet_length("text") + 64)).collect()
    assert len(got) <= total and max(g[1] for g in got) <= 40_000


def test_most(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    assert cells(df, 1, 10)[1] <= 12
