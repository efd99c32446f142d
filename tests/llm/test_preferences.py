import random

from pyspark.sql import functions as F

from tallyforge.llm import preferences as P


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for k in {c // 2 for c in convs}:
        a, b = (sorted(convs[c]) if c in convs else [] for c in (2 * k, 2 * k + 1))
        n = 0
        while n < min(len(a), len(b)) and a[n][2:] == b[n][2:]:
            n += 1
        say = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for *_, r, x in ts)

        def mask(ts):
            at, spans = 0, []
            for *_, r, x in ts:
                head = at + len("<|im_start|>") + len(r) + 1
                at = head + len(x) + len("<|im_end|>\n")
                if r == "assistant":
                    spans.append(f"{head}:{at}")
            return ",".join(spans)

        out[k] = (n, say(a[:n]), say(a[n:]) if a else None, say(b[n:]) if b else None, mask(a[n:]), mask(b[n:]))
    return out


def test_brute_force(spark):
    r = random.Random(6)
    rows = []
    for k in range(80):
        shared = [(r.choice(["user", "assistant", "system"]), r.choice(["hi", "é🙂", "", "same"])) for _ in range(r.randrange(0, 4))]
        for c in r.choice([(0, 1), (0, 1), (0,), (1,)]):
            for i, (role, text) in enumerate(shared + [(r.choice(["user", "assistant"]), r.choice(["x", "y"])) for _ in range(r.randrange(0, 3))]):
                rows.append((2 * k + c, i, role, text))
    rows += [(None, 0, "user", "x"), (400, None, None, None), (400, 1, "assistant", "a"), (401, 0, "", ""), (401, 1, "assistant", "b"), (500, 1, "user", "dup"), (500, 1, "user", "dup"), (501, 1, "user", "x" * 100000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, usable int").repartition(3)
    got = P.formatted(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0)
    said = got.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", P._said("chosen_mask").alias("c"), P._said("rejected_mask").alias("r"), "usable").collect()
    want = brute(rows)
    assert {g.pair_id: tuple(g)[1:7] for g in said} == want
    assert all(g.usable == bool(g.c and g.r) for g in said)
    assert P.formatted(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0
