import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import distances as D
from corvane.operators import series as S

A = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 1.0, 3.0]


def value(spark, f, a=A):
    return spark.createDataFrame([(a,)], "a array<double>").select(f(F.col("a"))).first()[0]


def test_standardise_and_constant(spark):
    x = np.array(A)
    assert value(spark, S.standardise) == pytest.approx(((x - x.mean()) / x.std()).tolist())
    assert value(spark, S.standardise, [2.0] * 4) == [0.0] * 4


def test_paa_fractional_frames_keep_the_mean(spark):
    assert np.mean(value(spark, lambda a: S.paa(a, 3))) == pytest.approx(np.mean(A))


def test_power_spectrum(spark):
    assert value(spark, S.power_spectrum) == pytest.approx(np.abs(np.fft.fft(A))[:4].tolist())


def test_run_lengths(spark):
    assert sum(k * n for k, n in enumerate(value(spark, S.run_lengths), 1)) == len(A)


def test_elastic_distances():
    a, b = np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])
    assert D.dtw(a, b) == 0 and D.dtw(a, a + 1) == 2
    assert D.lcss(a, a) == 0 and D.erp(a, a) == 0


@pytest.mark.parametrize("name", ["dtw", "erp", "lcss"])
def test_elastic_queries_take_all_rows(spark, tmp_path, name):
    from corvane import queries

    rnd = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rnd.integers(0, 4, 9 if i == 7 else 12)], 0) for i in [0, 5, 7, 19, 25, 100, 150, 200]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.a_id, r.b_id): r.distance for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    want = {(a, b): getattr(D, name)(np.array(x), np.array(y)) for a, x, _ in rows for b, y, _ in rows if a % 100 == 0 and a != b}
    assert found == pytest.approx(want) and len(set(want.values())) > 3


def test_nearest_ignores_itself(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [9.0, 9.0])], "id long, s array<double>")
    assert {(r.q, r.c) for r in D.nearest(rows, rows).collect()} == {(1, 2), (2, 1), (3, 2)}


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["label", "n", "correct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
