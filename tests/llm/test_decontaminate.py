import random

from tallyforge.llm import decontaminate as D


def test_brute_force(spark):
    r = random.Random(5)
    vocab = ["alpha", "b", "Ça", "d9", "eé", "x", "und", "the"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(str(i), say(r.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(12)] + [("3", "alpha, B x"), (None, "x"), ("nul", None)]
    docs = [(i, (items[r.randrange(12)][1].upper() if i % 3 == 0 else say(30)) + "--" + say(r.choice([0, 5, 60])), 7) for i in range(60)]
    docs += [(60, None, 1), (61, "", 1), (None, "alpha the", 1), (3, "x", 1), (3, "x", 1), (62, say(4000), 2)]
    real = [(i, t) for i, t in items if i]
    for block in (1 << 20, 100):
        got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block).collect()
        assert len(got) == len(docs)
        want = sorted((d[0] is None, d[0], *map(str, D.brute(d[1], real))) for d in docs if d[0] is not None)
        have = sorted((False, g.doc_id, str(g.n_words), str(g.n_hit), str(g["items"])) for g in got if g.doc_id is not None)
        assert have == want
        for g in got:
            assert (g.longest > 0) == (g.n_items > 0) and (g.longest_item in g["items"] if g.longest else g.longest_at is None)


def test_longest_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "pre " + " ".join(f"w{i}" for i in range(3, 15)) + " post", "n"), (2, "clean words only here", "n")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_items string")
    bench = spark.createDataFrame([(5, item), (6, item + " tail")], "item_id long, text string")
    got = {g.doc_id: g for g in D.contamination(df, bench).collect()}
    assert (got[1].longest, got[1].longest_at, got[1].longest_item, got[1]["items"]) == (12, 1, "5", ["5", "6"])
    left = D.decontaminate(df, bench)
    assert left.columns == df.columns and [r.doc_id for r in left.collect()] == [2]
    assert D.decontaminate(df, bench.where("item_id = 5")).count() == 1 and D.decontaminate(df, bench, min_items=3).count() == 2
    assert D.decontaminate(df, bench.limit(0)).count() == 2 and D.contamination(df.limit(0), bench).count() == 0
