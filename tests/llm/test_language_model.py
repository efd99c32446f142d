import math
import random
import zlib
from collections import Counter

import pytest

from tallyforge.llm import _text as X
from tallyforge.llm import language_model as L


def split(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [int(X.hash_word(w)) for w in t.split(" ") if w] + [int(L.END)]


def brute(docs, train, share, order=3):
    """(n_tokens, n_known, N, base, score) of each text with explicit n-gram tables."""
    toks = [split(t) for t in docs]
    end = int(L.END)
    uni = Counter(w for t, m in zip(toks, train) if m for w in t)
    n, v = sum(uni.values()), len(uni)
    tables, histories = [], None
    for k in range(2, order + 1):
        c = Counter()
        for t, m in zip(toks, train):
            if m:
                p = [end, *t]
                c.update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
        c = {g: x for g, x in c.items() if x >= max(1.0, share * n) and (histories is None or g[:-1] in histories)}
        tables.append(c)
        histories = c
    walker = L.Walker(tables, n, v, dict(uni))
    base = {w: math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for t in toks for w in t}
    return [(len(t), sum(uni.get(w, 0) > 0 for w in t), n, sum(base[w] for w in t), walker.text(t[:-1], base)) for t in toks]


@pytest.mark.parametrize("share", [2e-3, 0.02])
def test_brute_force(spark, share):
    r = random.Random(11)
    vocab = ["the", "of", "a", "Übung", "x1", "who", "no,", "|"] + [f"rare{i}" for i in range(80)]
    say = lambda n: r.choice([" ", "\n", "\t "]).join(r.choices(vocab, [40, 30, 20, 10, 5, 5, 3, 3] + [0.3] * 80, k=n))
    docs = [(i, say(r.randrange(0, 60)).title(), 3) for i in range(150)] + [(900, None, 1), (901, "", 1), (902, "  ", 1), (None, "the of", 1), (7, "the a", 1), (7, "the a", 1), (903, say(5000), 1)]
    held = [zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 7 == 2 for d in docs]
    want = brute([d[1] for d in docs], [not h for h in held], share)
    df = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3)
    for bucket in (1 << 20, 3000):
        got = L.score(df, share=share, bucket=bucket).collect()
        key = lambda x: (x[0] is None, x[0] or 0, *[round(y, 6) for y in x[1:]])
        assert sorted(key((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score)) for g in got) == sorted(key((d[0], *w)) for d, w in zip(docs, want))


def test_proper_distribution():
    """The arcs and failures of each state leave a total mass of one."""
    words = {1: 50, 2: 30, 3: 20}
    tables = [{(1, 2): 20, (1, 1): 10, (2, 3): 15}, {(1, 2, 3): 9, (1, 1, 2): 4}]
    w = L.Walker(tables, 100, 3, words)
    base = {k: math.log10((c + 1) / 104) for k, c in {**words, 9: 0}.items()}

    for state in ((), (1,), (2,), (1, 2), (1, 1), (3,)):
        assert abs(sum(10 ** w.step(state, x, base) for x in (1, 2, 3, 9)) - 1) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(df).count() == 0
    one = L.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), train=L.F.lit(False)).collect()
    assert one[0].n_known == 0 and one[0].base_score == 0.0 and one[0].score == 0.0


def test_no_ngram_is_cut(spark):
    """N-grams of any count are arcs by default, wherever their texts stand: held-out texts keep a rare context."""
    filler = [f"f{i % 700} g{i % 311}" for i in range(60_000)]
    docs = [(i, " ".join(filler[60 * i : 60 * i + 60])) for i in range(1000)] + [(2000, "green ideas sleep"), (3000, "green ideas sleep"), (-7, "say green ideas sleep"), (4000, "so colourless green ideas")]
    train = [d[0] != -7 for d in docs]
    want = brute([d[1] for d in docs], train, 0.0)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for bucket in (1 << 20, 9000):
        got = {g.doc_id: g for g in L.score(df, train=L.F.col("doc_id") != -7, bucket=bucket).collect()}
        for d, w in zip(docs, want):
            assert abs(got[d[0]].score - w[4]) < 1e-6 and got[d[0]].n_known == w[1]
    assert got[-7].score > got[-7].base_score + 5


def test_disk(spark):
    """Exchanged n-grams take few bytes a token, and score() leaves none of their exchanges behind."""
    import time

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{w}" for w in r.zipf(1.3, 400) % 50_000)) for i in range(1500)]
    block = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(docs), np.int32)), pa.array(np.ones(len(docs), bool)), pa.array([d[1] for d in docs])], ["bucket", "train", "text"])
    sent = sum(b.nbytes for b in L._asked(4, 3)(iter([block])))
    assert sent < 12 * 401 * len(docs)

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2).localCheckpoint()
    before = set(left())
    out = L.score(df, bucket=1 << 20)
    until = time.time() + 20
    while (own := sum(n for f, n in left().items() if f not in before)) >= sent / 10 and time.time() < until:
        time.sleep(0.5)
    assert own < sent / 10
    assert out.count() == len(docs)
