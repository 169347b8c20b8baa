import numpy as np
import pytest

import __spark_entry__ as entry


def test_every_pair_of_components_is_correlated(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(50, 6))
    v[:, 5] = 2 * v[:, 4] + 1  # a redundant pair beyond the first components
    spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.a, r.b): r.correlation for r in entry.queries()["feature_correlation_all"](spark, str(tmp_path)).collect()}
    want = np.corrcoef(v, rowvar=False)
    assert got == {(a, b): pytest.approx(want[a, b], abs=1e-5) for a in range(6) for b in range(a + 1, 6)}
    assert got[4, 5] == pytest.approx(1)


def test_all_pairs_equal_the_statement(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {(a, b): c for a, b, c in con.execute(entry.oracle_sql()["feature_correlation_all"]).fetchall()}
    got = {(r.a, r.b): r.correlation for r in entry.queries()["feature_correlation_all"](spark, sf).collect()}
    assert len(want) == 2016 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
