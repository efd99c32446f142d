import hashlib
import random

from tallyforge.llm import fingerprints as P


def expect(docs):
    """docs: (doc_id, text) with distinct or null ids at the end."""
    rows = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = P.brute(t), P.brute(e), P.brute(nxt)
        out[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, sum(x == y for x, y in zip(a, b)) / len(a), sum(x == y for x, y in zip(a, c)) / len(a))
    return out


def test_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocab = ["a", "É", "the", "of", "x1", "🙂", "Und", "lang", "wort"]
    docs = [(i * r.choice([1, 1, 7]) + 100 * i, r.choice([" ", "\n", "  "]).join(r.choice(vocab) for _ in range(r.randrange(0, 30)))) for i in range(60)]
    docs += [(99999, None), (99998, ""), (99997, "the " * 5000), (None, "null id")]
    want = expect(docs)
    df = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, near_next double, range int").repartition(3)
    for size in (1 << 20, 400):
        monkeypatch.setattr(P.in_ranges, "__defaults__", (size,))
        got = P.fingerprints(df).collect()
        assert len(got) == len(docs)
        for g in got:
            assert (g.n_chars, g.edited_sha256, list(g.sketch), list(g.edited_sketch), g.near_edited, g.near_next) == want[g.doc_id], g.doc_id


def test_repeats_and_small(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "other"), (None, "x"), (None, "y")], "doc_id long, text string")
    got = P.fingerprints(df).collect()
    assert len(got) == 5 and sorted(g.n_chars for g in got) == [1, 1, 5, 7, 7] and len({tuple(g.sketch) for g in got if g.n_chars == 7}) == 1
    one = P.fingerprints(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert P.fingerprints(df.limit(0)).count() == 0


def test_collision_rate():
    """Equal entries follow the generalised Jaccard similarity."""
    r = random.Random(1)
    a = [f"w{r.randrange(60)}" for _ in range(200)]
    b = a[:140] + [f"w{r.randrange(60)}" for _ in range(60)]
    from collections import Counter

    x, y = Counter(a), Counter(b)
    exact = sum((x & y).values()) / sum((x | y).values())
    s, t = P.brute(" ".join(a), 400), P.brute(" ".join(b), 400)
    assert abs(sum(i == j for i, j in zip(s, t)) / 400 - exact) < 0.08


def test_error_of_a_row(spark):
    """near_edited of half-edited texts is off by about 0.06, not by an eighth."""
    from collections import Counter

    texts = {i: " ".join(f"{i:03d}{k:02d}" for k in range(40)) for i in range(200)}
    got = P.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    off = []
    for g in got:
        t, n = texts[g.doc_id], texts[(g.doc_id - 1) % 200]
        x, y = Counter(t.split()), Counter((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).split())
        off.append(g.near_edited - sum((x & y).values()) / sum((x | y).values()))
    assert (sum(e * e for e in off) / len(off)) ** 0.5 < 0.08


def test_dataframe_functions_only(spark):
    """No Python runs on the executors; only A-Z are lower-cased, whatever else a word has."""
    texts = spark.range(4).selectExpr("id doc_id", "element_at(array('ÉA b B', 'Éa b b', 'éa b b', 'a B'), cast(id as int) + 1) text")
    out = P.fingerprints(texts)
    plan = out._jdf.queryExecution().toString()
    assert not [x for x in ("Arrow", "Python", "Pandas") if x in plan]
    got = {g.doc_id: list(g.sketch) for g in out.collect()}
    assert got[0] == got[1] != got[2] and got == {k: P.brute(t) for k, t in enumerate(["Éa b b", "Éa b b", "éa b b", "a b"])}
