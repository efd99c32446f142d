import random

import pytest

from tallyforge.operators import graph
from tallyforge.llm import near_duplicates as N


def brute(docs, k):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def corpus(r, near):
    say = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    docs, shared = [], say(30)
    for _ in range(40):
        base = say(r.choice([1, 3, 60, 150])) + (shared if r.random() < 0.4 else [])
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = "x" + str(r.random())
            docs.append(" ".join(w))
    base = say(120)
    for _ in range(near):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = "y" + str(r.random())
        docs.append("\n".join(w))
    docs += [" ".join(base).upper()] * 20
    r.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)] + [(5, None), (6, ""), (8, " \t "), (None, docs[0]), (1, docs[0]), (1, docs[0]), (9, "a"), (11, "A"), (None, "no id"), (12, " ".join(say(20000)))]


@pytest.mark.parametrize("small,cluster", [(256, 2000), (8, 20)])
def test_brute_force(spark, monkeypatch, small, cluster):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "CLUSTER", cluster)
    docs = corpus(random.Random(small), 120)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int").repartition(3)
    for k in (4, 5):
        got = N.similar_sets(df, shingle=k).collect()
        assert sorted((str(g.doc_id), g.n_shingles, str(g.component_id)) for g in got) == brute(docs, k)
        assert all(g.kept == (g.doc_id == g.component_id) for g in got)
        if small == 256:
            break


def test_keep_one(spark):
    df = spark.createDataFrame([(2, "a b c d e f"), (1, "A b c d e f"), (3, "other words"), (4, None), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.without_near_duplicates(df).collect()) == [1, 3, 4, 5]
    assert N.similar_sets(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(r.randrange(300, 330), r.randrange(300, 330)) for _ in range(40)] + [(None, 3), (7, 7), (1, 0)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {g.node: g.root for g in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
