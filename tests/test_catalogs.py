import duckdb
import pytest

from tallyforge.functions import channels as C
from tallyforge.model import EngineError
from tallyforge.operators import catalogs
from tallyforge.plans import classify

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["id83_classify", "tally_face"])
def test_sql_form(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = classify.Q[name](spark, SF)
    want = con.execute(classify.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["context_lookup", "tally_face", "id83_classify"])
def test_line_ends(spark, tmp_path, name):
    """Bases that a line end follows: no part of it is one of ACGT."""
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    con.execute(f"COPY (SELECT d AS doc_id, repeat('a', d % 2) || repeat('abcde' || chr(10) || 'fgt' || chr(10), 300) AS text FROM range(200) r(d)) TO '{tmp_path}/documents.parquet'")
    for table in ("orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = classify.Q[name](spark, str(tmp_path))
    want = con.execute(classify.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_indels(spark):
    #       0123456789...
    seq = "GACAAAATTCGCGTACGTTTGGACTGACCA"
    rows = [
        (4, "AA", "A", None), (3, "CA", "C", "1:Del:T:3"), (3, "C", "CA", "1:Ins:T:4"), (9, "TCG", "T", "2:Del:R:1"), (3, "TA", "T", "anchor_mismatch"), (99, "A", "AC", "context_bounds"),
        (29, "C", "CTT", "context_bounds"), (21, "GGACT", "G", "4:Del:M:3"),
    ]
    records = spark.createDataFrame([("s", "c", p, r, a) for p, r, a, _ in rows], "sample string, chrom string, pos long, ref string, alt string")
    for size in (4, 1 << 16):
        got = {(g.pos, g.ref, g.alt): g.reason or g.channel for g in catalogs.indels(records, spark.createDataFrame([("c", seq)], "chrom string, seq string"), size).collect()}
        for p, r, a, want in rows:
            assert want is None or got[p, r, a] == want, (p, r, a, got[p, r, a])
        assert set(got.values()) <= set(C.id83()) | {"anchor_mismatch", "context_bounds", "insertion_microhomology"}


def test_modes(spark):
    seq = spark.createDataFrame([("c", "TTACGTACGTACGNTACGTT")], "chrom string, seq string")
    rows = [("s", "c", 4, "C", "T", "T"), ("s", "c", 5, "G", "A", "T"), ("s", "c", 8, "C", "A", "B"), ("s", "c", 13, "G", "A", "N"), ("s", "c", 1, "T", "A", "N"), ("s", "c", 10, "A", "C", "U"), ("t", "c", 8, "X", "A", "N"), ("t", "c", 9, "GT", "G", "N")]
    v = spark.createDataFrame(rows, "sample string, chrom string, pos long, ref string, alt string, strand string")
    fates = lambda m: {r.reason: r.n for r in catalogs.fates(v, seq, m).collect()}
    assert fates("SBS96") == {"ok": 1, "n_context": 1, "context_bounds": 1, "ref_mismatch": 1, "invalid_base": 1}
    assert fates("SBS192") == {"strand": 1, "n_context": 1, "context_bounds": 1, "ref_mismatch": 1, "invalid_base": 1}
    assert fates("DBS78") == {"ok": 2, "invalid_base": 1} and fates("ID83") == {"ok": 1, "invalid_base": 1}
    got = catalogs.catalog(v, seq, "DBS78")
    assert [(r.sample, r.channel) for r in got.where("n > 0").collect()] == [("s", "CG>TA")] and got.count() == 2 * 78
    assert catalogs.catalog(v.limit(0), seq, "SBS1536").count() == 0
    with pytest.raises(EngineError):
        catalogs.catalog(v, seq, "SBS97")
    with pytest.raises(EngineError):
        catalogs.catalog(v.drop("strand"), seq, "SBS192")
