import random

from tallyforge.llm import url_templates as U


def test_brute_force(spark):
    r = random.Random(2)
    hosts = ["a.example.com", "WWW.Example.com", "x.net", "net", "big.org", "big.org", "big.org", "notcom"]
    seg = lambda: r.choice(["en", "de", "fr", "es", "spam", str(r.randrange(1000)), f"p{r.randrange(400)}", f"{r.randrange(99)}.html", ""])
    pages = [(i, f"http{r.choice(['', 's'])}://{r.choice(hosts)}" + "".join("/" + seg() for _ in range(r.choice([0, 1, 2, 2, 3, 12]))) + r.choice(["", "?q=/x", "#t"])) for i in range(1500)]
    pages += [(2000, None), (2001, ""), (2002, "no scheme/en/"), (2003, "a://b://c/d\ne"), (None, "http://x.net/es/1"), (7, "http://x.net/en/"), (7, "http://x.net/en/"), (2004, "http://long.org/" + "s/" * 5000), (2005, "http://long.org/" + "s/" * 5000 + "t"), (2006, "http://long.org/s"), (2007, "http://long.org/s/s/u")]
    pages += [(2100 + i, f"http://deep.org/a/b/c/d/e/f/g/h/i/{i % 40}/{'spam' if i % 3 else 'en'}/{i}") for i in range(120)]
    bad = lambda u: "spam" in (u or "")
    labels = [(i, 0 if bad(u) and r.random() < 0.9 else int(r.random() < 0.95)) for i, u in pages if r.random() < 0.5] + [(None, 0), (3, None), (4, 1), (4, 0)]
    got = U.judged(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, template string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(key((g.page_id, g.host, g.path, g.rule, g.verdict, g.template)) for g in got) == sorted(map(key, U.brute(pages, labels)))
    assert {g.verdict for g in got if g.rule is None} == {"allow", "block"}


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", 1, 2, "x")], "page_id long, url string, `at` int, parts int, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert U.judged(pages.limit(0), labels).count() == 0
    assert [g.verdict for g in U.judged(pages, labels).collect()] == ["allow"]
