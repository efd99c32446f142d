import random

from tallyforge.llm import secrets as S


def test_brute_force(spark):
    r = random.Random(7)
    some = lambda a, n: "".join(r.choice(a) for _ in range(n))
    b64, hx = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    make = [
        lambda: "Password: " + some(b64, r.randrange(1, 20)), lambda: "api_key='" + some(b64, 12) + "'", lambda: "token=token: abcdefghij", lambda: "AKIA" + some("ABCXYZ0123", r.randrange(0, 30)),
        lambda: some(hx, r.randrange(20, 50)), lambda: some(b64, r.randrange(15, 60)), lambda: "ünï 🙂 the", lambda: "secret = short", lambda: "x" * 30, lambda: "/usr/local/share/some/file/name", lambda: "EXAMPLE" + some(b64, 20),
        lambda: some(b64, 25) + "A" * r.randrange(6, 12) + some(b64, 25), lambda: some(b64, 30) + "Z" + some(hx, 34) + "Z" + some(b64, 30), lambda: some(b64, 22) + "sample" + some(b64, 5) + "Dummy" + some(b64, 24),
    ]
    docs = [(i, r.choice([" ", "\n", "é "]).join(r.choice(make)() for _ in range(r.randrange(0, 12))), 1) for i in range(300)]
    docs += [(900, None, 1), (901, "", 1), (None, "AKIA" + "Z" * 12, 1), (950, "x", 1), (950, "x", 1), (902, "word " * 50000 + "token=abcdefgh12", 1), (903, some(b64, 20000), 1), (904, " ".join(some(b64, 24) for _ in range(2000)), 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cand int").repartition(3)
    got = S.scan(df).collect()
    assert len(got) == len(docs) and got[0].cand == 1
    for g in got:
        want = S.brute(g.text)
        assert [tuple(s) for s in g.secret_spans] == want, g.text
        assert [tuple(s) for s in g.base_spans] == [w for w in want if w[1] < 3]
    assert any(s.kind == 3 for g in got for s in g.secret_spans)
    clean = S.redact(df.withColumnRenamed("cand", "n_chars")).collect()
    for g in clean:
        raw = next(d[1] for d in docs if d[0] == g.doc_id)
        if raw is None:
            assert g.text is None
            continue
        out, at = "", 0
        for s, _, e in S.brute(raw):
            if s >= at:
                out += raw[at:s] + S.MASK
            at = max(at, e)
        assert g.text == out + raw[at:] and g.n_chars == (len(g.text) if g.text != raw else 1)
    assert S.scan(df.limit(0)).count() == 0


def test_query(spark):
    import hashlib

    rows = S.op4(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for g in rows:
        spans = S.brute(docs[g.doc_id])
        say = lambda x: ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in x)
        base = [x for x in spans if x[1] < 3]
        assert g.spans == say(spans) and g.base_sha256 == hashlib.sha256(say(base).encode()).hexdigest()
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
