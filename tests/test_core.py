"""The engine's operators against fixed values and brute force."""

import itertools
import os
import shutil
import subprocess
import sys
import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.models import features, neighbours
from corvane.operators import batch as B
from corvane.operators import columns as C
from corvane.operators import elastic as E
from corvane.operators import metrics as M
from corvane.operators import rows as R
from corvane.operators import series as S
from corvane.operators import shapelets as H
from corvane.sources import files as X

A, BB = [1, 2, 3, 4, 5], [6, 11, 15, 2, 7]
LONG, SHORT = [5, 3, 2, 7, 4, 2, 1, 8, 8, 7, 4, 4, 2, 1, 3], [7, 6, 1, 7, 7, 7, 3, 3, 5, 6]


@pytest.mark.parametrize("want, got", [
    (203, lambda: E.dtw(A, BB)), (212, lambda: E.dtw(A, BB, 0.4)), (258, lambda: E.dtw(A, BB, 0.0)), (258, lambda: E.euclidean(A, BB)),
    (57, lambda: E.dtw(SHORT, LONG)), (57, lambda: E.dtw(LONG, SHORT)), (np.inf, lambda: E.dtw(SHORT, LONG, limit=10)), (57, lambda: E.dtw(SHORT, LONG, 0.25)), (np.inf, lambda: E.dtw(SHORT, LONG, 0.25, limit=20)),
    (182, lambda: E.erp(A, BB, 1.5)), (175, lambda: E.erp(A, BB, 2)), (189.5, lambda: E.erp(A, BB, 1.5, 0.2)),
])
def test_elastic_fixed_values(want, got):
    assert got()[0] == want


def test_elastic_distances_hold_together():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 20)), rng.normal(size=(60, 20))
    for name, f in E.DISTANCES.items():
        assert np.allclose(f(a, a), 0, atol=1e-12), name
        assert np.allclose(f(a, b), f(b, a)), name
        assert np.allclose(f(a, b), [f(x, y)[0] for x, y in zip(a, b)]), name
    assert np.allclose(E.dtw(a[:, None], b[:, None]), E.dtw(a, b))
    two_a, two_b = np.stack((a, b), 1), np.stack((b, a), 1)
    assert np.allclose(E.independent(E.dtw, two_a, two_b), 2 * E.dtw(a, b))
    for bound in (E.lb_kim(a, b), E.lb_keogh(a, b, 20), E.lb_improved(a, b, 20), E.lb_enhanced(a, b, 20), E.lb_yi(a, b)):
        assert (bound <= E.dtw(a, b) + 1e-9).all()
    assert (E.lb_wdtw(a, b) <= E.weighted_dtw(a, b) + 1e-9).all() and (E.lb_lcss(a, b, 20) <= E.lcss(a, b) + 1e-9).all()
    assert (E.lb_msm(a, b) <= E.msm(a, b) + 1e-9).all() and (E.lb_twed(a, b) <= E.twed(a, b) + 1e-9).all()


def value(spark, f, a):
    return spark.createDataFrame([(a,)], "a array<double>").select(f(F.col("a"))).first()[0]


@pytest.mark.parametrize("a", [[], [3.0], [2.0, 2.0, 2.0], [1.0, 5.0, 2.0]])
def test_series_on_odd_input(spark, a):
    """Empty, single, constant and short series neither crash nor give more than they should."""
    n = len(a)
    assert len(value(spark, S.standardise, a)) == n and len(value(spark, S.derivative, a)) == n
    assert len(value(spark, S.autocorrelation, a)) == max(0, n - 1)
    assert sum(k * x for k, x in enumerate(value(spark, S.run_lengths, a), 1)) == n
    assert len(value(spark, S.power_spectrum, a)) == n // 2 and len(value(spark, S.differences, a)) == max(0, n - 1)
    assert len(value(spark, S.summary, a)) == 5 and len(value(spark, lambda c: S.convolve(c, [1.0, 1.0]), a)) == max(0, n - 1)
    assert len(value(spark, lambda c: S.sliding(c, 2), a)) == max(0, n - 1)


@pytest.mark.parametrize("f", [B.fourier, B.power_spectrum, B.power_cepstrum, B.cosine, B.sine, B.hilbert, B.spectrogram, B.mfcc, B.audio_features, B.both_autocorrelations, B.autoregression, B.matrix_profile, B.slopes, B.gradient_histograms, B.haar, B.subsequences, B.Rocket(5, 30), B.catch22, B.summary])
def test_matrix_transforms_on_constant_and_short_series(f):
    for x in (np.full((2, 30), 3.0), np.arange(24.0).reshape(2, 12)):
        out = f(x)
        assert len(out) == 2 and np.isfinite(out).all()


def test_matrix_transforms_against_brute_force():
    x = np.random.default_rng(2).normal(size=(3, 24))
    profile = B.matrix_profile(x, 5)
    w = [(lambda v: (v - v.mean()) / v.std())(x[1, i : i + 5]) for i in range(20)]
    want = [min(((w[i] - w[j]) ** 2).sum() for j in range(20) if abs(i - j) > 7.5) for i in range(20)]
    assert profile[1, :20] == pytest.approx(want)
    assert B.partial_autocorrelations(x, 5)[:, 0] == pytest.approx(B.autocorrelations(x, 5)[:, 0])
    shapelet = x[0, 4:10]
    d = H.distances_to(shapelet[None], x)
    z = (shapelet - shapelet.mean()) / shapelet.std()
    assert d[0, 0] == pytest.approx(0, abs=1e-9)
    assert d[2, 0] == pytest.approx(min((((lambda v: (v - v.mean()) / v.std())(x[2, i : i + 6]) - z) ** 2).mean() for i in range(19)))


def test_positions_do_not_need_one_task(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 50)) if i % 7 else None, "ab"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, x double, g string").repartition(5)
    for by in ([], ["g"]):
        found = {r.k: r.position for r in R.positions(df, [F.col("x").asc_nulls_last(), F.col("k")], F.col("x"), by, parts=9).collect()}
        for g in {r[2] if by else 0 for r in rows}:
            own = sorted((r for r in rows if not by or r[2] == g), key=lambda r: (r[1] is None, r[1] or 0, r[0]))
            assert [found[r[0]] for r in own] == list(range(len(own)))


def test_expressions(spark):
    df = spark.createDataFrame([(3.0, 2.0)], "p double, q double")
    for text, want in (("a1+a2*2", 7), ("(a1+a2)*2", 10), ("-a1^2", -9), ("a1-a2-1", 0), ("2^a1^1", 8), ("sqrt(a1*a1)/a2", 1.5), ("1/(a1-3)", None), ("rint(2.6)+floor(-0.5)", 2)):
        assert C.add_expression(df, text).first()["expression"] == want, text
    for text in ("a1 +", "(a1", "a1 a2", "$"):
        with pytest.raises(ValueError):
            C.expression(text, ["p", "q"])


def test_assignment_is_the_best_one():
    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (2, 5), (5, 2), (4, 4)):
        gain = rng.integers(0, 20, (n, m))
        small, large = sorted((n, m))
        best = max(sum(gain[i, j] if n <= m else gain[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
        pairs = M.best_assignment(gain)
        assert sum(gain[i, j] for i, j in pairs) == best and len(pairs) == small


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 5.0, None) for i in range(4)], "k long, x double, y double")
    assert {r.x for r in C.normalize(df, ["x"])(df).collect()} == {0.0} and {r.x for r in C.standardize(df, ["x"])(df).collect()} == {0.0}
    assert {r.x for r in C.discretize(df, ["x"])(df).collect()} == {0} and {r.y for r in C.normalize(df, ["y"])(df).collect()} == {None}
    none = df.limit(0)
    assert C.center(none, ["x"])(df).count() == 4 and R.bootstrap(none, "k").count() == 0


def test_arff_with_quotes_gaps_and_sparse_rows(spark, tmp_path):
    path = str(tmp_path / "x.arff")
    with open(path, "w") as f:
        f.write("% a comment\n@RELATION 'my data'\n@attribute 'the x' numeric\n@attribute g {a,'b c',d}\n@attribute s string\n@data\n1.5,'b c','it\\'s, so'\n?,a,?\n{0 2, 2 'z'}\n{}\n")
    found = [tuple(r)[1:] for r in X.read_arff(spark, path).orderBy("rid").collect()]
    assert found == [(1.5, "b c", "it's, so"), (None, "a", None), (2.0, "a", "z"), (0.0, "a", None)]


def test_relational_arff(spark, tmp_path):
    path = str(tmp_path / "m.arff")
    with open(path, "w") as f:
        f.write("@relation m\n@attribute bag relational\n@attribute t0 numeric\n@attribute t1 numeric\n@end bag\n@attribute c {u,v}\n@data\n'1,2\\n3,4',u\n")
    assert [tuple(r) for r in X.read_arff(spark, path).collect()] == [(0, [[1.0, 2.0], [3.0, 4.0]], "u")]


def test_ts_with_missing_values_and_unequal_lengths(spark, tmp_path):
    path = str(tmp_path / "x.ts")
    df = spark.createDataFrame([(0, "b", [[1.0, None, 2.5]]), (1, "a", [[4.0]])], "series_id long, label string, dims array<array<double>>")
    X.write_ts(df, path, "Odd")
    header = X.ts_header(spark, path)
    assert header["equallength"] == "false" and header["missing"] == "true" and header["classlabel"] == ["a", "b"]
    assert [tuple(r) for r in X.read_ts(spark, path).orderBy("series_id").collect()] == [(0, "b", 1, [[1.0, None, 2.5]]), (1, "a", 0, [[4.0]])]


def test_svmlight_comments(spark, tmp_path):
    path = str(tmp_path / "x.svmlight")
    with open(path, "w") as f:
        f.write("# header\n1 qid:3 1:0.5 4:2 # note\n-1 2:1e-3\n")
    assert [tuple(r) for r in X.load(spark, path).orderBy("rid").collect()] == [(0, 1.0, 3, [0, 3], [0.5, 2.0]), (1, -1.0, None, [1], [0.001])]


def test_xrff(spark, tmp_path):
    path = str(tmp_path / "x.xrff")
    with open(path, "w") as f:
        f.write("<dataset><header/><body><instances><instance><value>1</value><value missing='yes'/></instance><instance><value>2</value><value>b</value></instance></instances></body></dataset>")
    assert [r["values"] for r in X.load(spark, path).orderBy("rid").collect()] == [["1", None], ["2", "b"]]


def test_nearest_neighbours_learn(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in np.sin(np.arange(20) * (0.3 + 0.4 * (i % 2))) + 0.1 * rng.normal(size=20)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, s array<double>")
    train, test = df.where("id < 30"), df.where("id >= 30")
    for name in E.DISTANCES:
        if name == "lcss":
            continue
        told = neighbours.one_nn(name).fit(train).predict(test).collect()
        assert len(told) == 10 and sum(r.predicted == r.id % 2 for r in told) >= 9, name
    assert neighbours.dtw_cv(train, 3)[1] > 0.9 and neighbours.best_k(train, 3)[1] > 0.9
    told = features.rocket_classifier(train, 2, 50).predict(test).collect()
    assert all(r.predicted == r.id % 2 for r in told)


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "corpus_pipeline.py"))
    for pipeline in (False, True):  # with the pipeline's file left behind, too
        if pipeline and os.path.exists(f"{root}/corpus_pipeline.py"):
            shutil.copy(f"{root}/corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 300 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": copy})


def test_file_readers_follow_paths_not_sizes(spark, tmp_path):
    """Spark deals out large files first; rows are numbered by path all the same, and the header is found in a small first file."""
    parts = [["@relation t", "@attribute x numeric"], ["@data", "0"], [str(i) for i in range(1, 400)], ["400", "401"], [str(i) for i in range(402, 9000)]]
    folder = tmp_path / "a b.arff"
    folder.mkdir()
    for i, part in enumerate(parts):
        (folder / f"part-{i:05}.txt").write_text("".join(f"{x}\n" for x in part))
    (tmp_path / "m.m").mkdir()
    for i, part in enumerate(parts[1:]):
        (tmp_path / "m.m" / f"part-{i:05}.txt").write_text("".join(f"{x} 1\n" for x in part if x != "@data"))
    held = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}  # so that files are split, too
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert [r.x for r in X.load(spark, str(folder)).orderBy("rid").collect()] == list(range(9000))
        assert [(r.rid, r.v[0]) for r in X.load(spark, str(tmp_path / "m.m")).orderBy("rid").collect()] == [(i, i) for i in range(9000)]
    finally:
        for k in held:
            spark.conf.unset(k)


def test_writers_put_the_header_before_any_key(spark, tmp_path):
    X.write_arff(spark.createDataFrame([(-5, 1.0), (-9, 2.0), (3, 3.0)], "k long, x double"), str(tmp_path / "n.arff"), "t", "k")
    assert [r.x for r in X.load(spark, str(tmp_path / "n.arff")).orderBy("rid").collect()] == [2.0, 1.0, 3.0]


def test_attribute_ranking_ties_as_rounded(spark, tmp_path):
    """Gains that are equal to six decimals are ordered by name, as in the query's SQL."""
    from corvane.queries import QUERIES

    rows = [(i // 2 % 2 * 1.0, "NF"[i // 4 % 2], i // 8 % 7, "AR"[i % 2]) for i in range(11200)]
    rows[0] = (1.0, *rows[0][1:])  # tax alone tells a trace of the flag
    spark.createDataFrame(rows, "l_tax double, l_linestatus string, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["attribute_ranking"](spark, str(tmp_path)).collect()] == [("l_linenumber", 0.0), ("l_linestatus", 0.0)]


def _plain(name, a, b, window):
    """The recurrences cell by cell, for one pair of one dimension, a the longer."""
    n, m, inf = len(a), len(b), np.inf
    t = np.full((n + 1, m + 1), 0 if name == "lcss" else inf)
    between = lambda x, y, z: 1.0 if min(y, z) <= x <= max(y, z) else 1.0 + min(abs(x - y), abs(x - z))
    p, q = np.r_[0, a], np.r_[0, b]
    if name == "twed":
        t[0], t[:, 0] = np.r_[0, np.cumsum(np.diff(q) ** 2)], np.r_[0, np.cumsum(np.diff(p) ** 2)]
    for i in range(n):
        lo, hi = E.band(n, m, i, window)
        for j in range(lo, hi + 1):
            d, u, l, c = t[i, j], t[i, j + 1], t[i + 1, j], (a[i] - b[j]) ** 2  # noqa: E741
            if name == "dtw":
                t[i + 1, j + 1] = c + (min(d, u, l) if i or j else 0)
            elif name == "erp":
                t[i + 1, j + 1] = min(d + c, l + (b[j] - 0.01) ** 2, u + (a[i] - 0.01) ** 2) if i or j else 0
            elif name == "lcss":
                t[i + 1, j + 1] = d + 1 if abs(a[i] - b[j]) <= 0.01 else max(u, l)
            elif name == "msm":
                t[i + 1, j + 1] = min(d + abs(a[i] - b[j]), u + between(a[i], a[i - 1], b[j]), l + between(b[j], a[i], b[j - 1])) if i or j else abs(a[i] - b[j])
            else:
                both = i and j
                t[i + 1, j + 1] = min(d + 2 * abs(i - j) * (1 if both else 0.5) + c + ((p[i] - q[j]) ** 2 if both else 0), u + (a[i] - p[i]) ** 2 + 2, l + (b[j] - q[j]) ** 2 + 2)
    return 1 - t[n, m] / min(n, m) if name == "lcss" else t[n, m]


@pytest.mark.parametrize("name", ["dtw", "erp", "lcss", "msm", "twed"])
@pytest.mark.parametrize("n, m, window", [(9, 9, 1.0), (9, 4, 1.0), (7, 7, 0.2), (8, 5, 0.5), (6, 6, 0.0), (1, 1, 1.0), (5, 1, 1.0), (2, 2, 1.0)])
def test_anti_diagonals_against_plain_recurrences(monkeypatch, name, n, m, window):
    monkeypatch.setattr(E, "CELLS", 64)  # several groups of pairs
    if name == "lcss" and window < 1:
        pytest.skip("lcss in a band goes row by row, as before")
    rng = np.random.default_rng(n * m)
    a, b = rng.integers(-3, 4, (70, n)).astype(float), rng.integers(-3, 4, (70, m)).astype(float)
    want = np.array([_plain(name, x, y, window) for x, y in zip(a, b)])
    assert np.allclose(E.DISTANCES[name](a, b, window=window), want)
    if name != "lcss":
        limit = np.median(want[np.isfinite(want)]) if np.isfinite(want).any() else 1.0
        assert np.allclose(E.DISTANCES[name](a, b, window=window, limit=limit), np.where(want > limit, np.inf, want))


def test_series_are_prepared_once_not_for_each_pair(spark, tmp_path):
    from corvane.operators import distances as D

    log = str(tmp_path / "rows")

    def doubled(x):
        with open(log, "a") as f:
            f.write(f"{len(x)}\n")
        return 2 * x

    def distance(a, b):
        return E.dtw(doubled(a), doubled(b))

    distance.parts = doubled, E.dtw
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(40)], "id long, s array<double>").coalesce(1)
    found = {(r.a_id, r.b_id): r.distance for r in D.between(rows, rows, distance).collect()}
    assert len(found) == 40 * 39 and found[3, 5] == E.dtw([6.0, 4.0], [10.0, 8.0])[0]
    assert sum(int(x) for x in open(log)) == 80  # before: 3120


def test_few_bytes_are_still_many_tasks(spark):
    """Adaptive execution would make one task of small blocks, however long their pairs take."""
    from corvane.operators import distances as D

    rows = spark.createDataFrame([(i, [float(i)]) for i in range(2000)], "id long, s array<double>")
    parts = D.between(rows.where("id < 8"), rows, E.euclidean, block=64).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 8


def _clouds(spark, n=90, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) + rng.integers(0, 3, n)[:, None] * 4, 1)
    x[n // 2] = x[0]  # equal rows
    return x, spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, s array<double>, label int")


def _rows_written(spark, run):
    """The most rows in any table that a run leaves in the shared folder."""
    from corvane.storage import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    run()
    return max(spark.read.parquet(f"{folder}/{d}").count() for d in set(os.listdir(folder)) - before)


def test_density_peaks_by_blocks(spark):
    from corvane.models import clusterers

    x, df = _clouds(spark)
    d, n = ((x[:, None] - x[None]) ** 2).sum(2), len(x)
    for radius in (2.0, float(d[0, 1])):  # one of them right at a distance
        rho = (d <= radius).sum(1) - 1
        above = [[j for j in range(n) if rho[j] > rho[i] or (rho[j] == rho[i] and j < i)] for i in range(n)]
        want = {i: (rho[i], min(d[i, j] for j in above[i]) if above[i] else d[i].max()) for i in range(n)}
        found = {}
        assert _rows_written(spark, lambda: found.update({r.id: (r.density, r.separation) for r in clusterers.density_peaks(df, radius).collect()})) <= n  # before: all pairs
        assert found == {i: pytest.approx(w) for i, w in want.items()}
        near = {(r.a, r.b) for r in __import__("corvane.operators.distances", fromlist=["x"]).within_radius(df, radius, block=16).collect()}
        assert near == {(i, j) for i in range(n) for j in range(n) if i != j and d[i, j] <= radius}


def test_x_means_starts_once(spark, monkeypatch):
    from corvane.models import clusterers

    x, df = _clouds(spark)
    calls, start = [], clusterers.farthest_first
    monkeypatch.setattr(clusterers, "farthest_first", lambda d, k: calls.append(k) or start(d, k))
    centres, told = clusterers.x_means(df, 2, 4)
    assert calls == [4]  # before: 2, 3 and 4, each from the beginning
    assert {r.id: r.cluster for r in told.collect()} == dict(enumerate(((x[:, None] - centres[None]) ** 2).sum(2).argmin(1).tolist()))


@pytest.mark.parametrize("words", [2, 4096])
def test_nearest_bags_by_blocks(spark, words):
    from corvane.models import dictionary

    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (60, 7)) * (rng.random((60, 7)) < 0.4)
    bag = spark.createDataFrame([(i, f"w{k}", int(n)) for i, r in enumerate(x) for k, n in enumerate(r) if n], "id long, word string, n long")
    want = {}
    for i in range(0, 60, 5):
        near = [(int(((x[i] - x[j]) ** 2).sum()), j) for j in range(60) if j % 5 and (x[i] * x[j]).sum()]
        if near:
            want[i] = min(near)
    found = dictionary.nearest_bags(bag.where("id % 5 = 0"), bag.where("id % 5 <> 0"), size=8, words=words)
    assert {r.q: (r.distance, r.c) for r in found.collect()} == want


def test_shapelet_profiles_by_blocks(spark):
    """Blocks of shapelets of many series against blocks of series; a few lines for each block, not one for each pair."""
    rng = np.random.default_rng(2)
    s = {i: rng.normal(size=9 if i % 4 else 5).tolist() for i in range(20)}
    df = spark.createDataFrame([(i, i % 3, v) for i, v in s.items()], "id long, label int, s array<double>")
    found = {(r.id, r.c_id, r.start, r.size): (r.label, r.distance) for r in H.profile(df, H.candidates(df, [4, 6], 2), most=64).collect()}
    want = {(i, c, k, n): (i % 3, H.distances_to(np.array([s[c][k : k + n]]), np.array([s[i]]))[0, 0]) for i in s for c in s for n in (4, 6) for k in range(0, len(s[c]) - n + 1, 2) if len(s[i]) >= n}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["dtw", "wdtw", "twed", "lcss"])
@pytest.mark.parametrize("n, m, window", [(9, 9, 1.0), (9, 4, 1.0), (4, 9, 1.0), (7, 7, 0.2), (8, 5, 0.5), (6, 6, 0.0), (1, 1, 1.0), (5, 1, 1.0), (2, 2, 1.0), (70, 66, 1.0), (64, 64, 1.0)])
def test_every_pair_as_pair_by_pair(monkeypatch, name, n, m, window):
    monkeypatch.setattr(E, "ROOM", 64)  # several groups of rows
    rng = np.random.default_rng(n + m)
    x, y = rng.integers(-9, 10, (7, n)) / 100, rng.integers(-9, 10, (41, m)) / 100  # many just at lcss's 0.01, by rounding on either side of it
    distance = partial(E.DISTANCES[name], window=window)
    want = distance(np.repeat(x, len(y), 0), np.tile(y, (len(x), 1))).reshape(len(x), len(y))
    assert E.whole_of(distance, x, y) and np.array_equal(E.every(distance, x, y), want)
    assert np.array_equal(E.every(distance, x[:, None, :], y[:, None, :]), want)
    if name == "lcss" and window == 1:
        assert np.allclose([[_plain(name, *((a, b) if n >= m else (b, a)), window) for b in y] for a in x], want)


def test_lcss_of_every_pair_takes_words_not_cells():
    x = np.random.default_rng(1).normal(size=(500, 64)) / 8
    started = time.perf_counter()
    found = E.every(E.lcss, x[:100], x)
    whole, started = time.perf_counter() - started, time.perf_counter()
    pairs = E.lcss(np.repeat(x[:20], 500, 0), np.tile(x, (20, 1))).reshape(20, 500)
    assert np.array_equal(found[:20], pairs) and whole / 5 < (time.perf_counter() - started) / 2


@pytest.mark.parametrize("scale, move", [(1.0, 0.0), (1e-25, 0.0), (1.0, 1e5), (1e20, 0.0)])
@pytest.mark.parametrize("name, options", [("dtw", {"window": 0.1}), ("wddtw", {}), ("lcss", {}), ("twed", {})])
def test_nearest_by_single_precision_first(spark, monkeypatch, name, options, scale, move):
    from corvane.operators import distances as D

    x = np.random.default_rng(2).normal(size=(60, 12))
    x[31] = x[30] + 1e-11  # one row to nine decimals, two in single precision
    x[41] = x[40] * (1 + 1e-8)
    x = x * scale + move
    measure = partial(E.DISTANCES[name], **options)
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)], "id long, s array<double>").coalesce(1)
    found = {(r.q, r["rank"]): (r.c, r.distance) for r in D.nearest(rows, rows, 2, distance=measure).collect()}
    d = np.round(measure(np.repeat(x, 60, 0), np.tile(x, (60, 1))).reshape(60, 60), 9)
    d[np.arange(60), np.arange(60)] = np.inf
    want = {(i, r + 1): (int(c), d[i, c]) for i in range(60) for r, c in enumerate(np.lexsort((np.arange(60), d[i]))[:2])}
    assert found == want
    if name == "dtw" and scale == 1 and not move:
        single, off = E.rough(measure, x, x)
        np.fill_diagonal(d, 0.0)
        assert (abs(single - d) <= off(single)).all() and off(single).max() < 1e-3


@pytest.mark.parametrize("n, m, window", [(12, 12, 1.0), (12, 12, 0.1), (9, 4, 1.0), (4, 9, 0.5), (5, 1, 1.0), (1, 1, 1.0)])
def test_warping_of_several_dimensions_in_single_precision(monkeypatch, n, m, window):
    monkeypatch.setattr(E, "COSTS", 16 * n * m)  # several blocks of rows
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(7, 5, n)), rng.normal(size=(41, 5, m))
    x[2, 0, 0], y[5, 1, -1], y[6, 0, 0] = 1e4, -1e6, 1e4 + 1  # as steep slopes are
    measure = partial(E.dtw, window=window)
    want = measure(np.repeat(x, 41, 0), np.tile(y, (7, 1, 1))).reshape(7, 41)
    single, off = E.rough(measure, x, y)
    some = np.isfinite(want)
    assert np.array_equal(np.isfinite(single), some)
    assert (abs(np.where(some, single, 0) - np.where(some, want, 0)) <= off(np.where(some, single, 0))).all() and np.median(off(np.where(some, single, 0))) < 1e-2


def test_nearest_by_shape_as_pair_by_pair(spark):
    from corvane.operators import distances as D

    x = np.random.default_rng(4).normal(size=(50, 24)).cumsum(1)
    x[31], x[41] = x[30], x[40] * (1 + 1e-8)
    measure = neighbours.shape_distance(lambda w: B.slopes(w, 3), 12)
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)], "id long, s array<double>").coalesce(1)
    found = {(r.q, r["rank"]): (r.c, r.distance) for r in D.nearest(rows, rows, 2, distance=measure).collect()}
    d = np.round(measure(np.repeat(x, 50, 0), np.tile(x, (50, 1))).reshape(50, 50), 9)
    d[np.arange(50), np.arange(50)] = np.inf
    assert found == {(i, r + 1): (int(c), d[i, c]) for i in range(50) for r, c in enumerate(np.lexsort((np.arange(50), d[i]))[:2])}


@pytest.mark.parametrize("name, options", [("msm", {}), ("msm", {"c": 0.1}), ("msm", {"c": 3.0, "window": 0.2}), ("twed", {}), ("twed", {"nu": 0.01, "penalty": 0.05}), ("twed", {"nu": 0.0, "penalty": 2.0, "window": 0.2})])
@pytest.mark.parametrize("n", [64, 12, 2, 1])
def test_bounds_by_the_straight_path_and_a_band(monkeypatch, name, options, n):
    monkeypatch.setattr(E, "BAND", 200)  # several groups of rows
    measure = partial(E.DISTANCES[name], **options)
    for scale, move in ((1.0, 0.0), (0.125, 0.0), (0.125, 1e3), (10.0, 0.0), (1e-25, 0.0), (1e10, 0.0)):
        rng = np.random.default_rng(n)
        x, y = rng.normal(size=(9, n)) * scale + move, rng.normal(size=(33, n)) * scale + move
        y[3], y[4] = x[2], x[2] * (1 + 1e-9)
        d = measure(np.repeat(x, 33, 0), np.tile(y, (9, 1))).reshape(9, 33)
        high, lower = E.straight(measure, x, y)
        assert (d <= high).all()
        for limit in (d.min(1), np.sort(d, 1)[:, 5], np.median(d, 1), high.min(1), np.full(9, np.inf)):
            assert ((lower(limit) <= d) | (d > limit[:, None])).all()
    for odd in (np.full((2, n), np.nan), np.zeros((2, n + 1)), np.zeros((2, 2, n))):
        assert E.straight(measure, odd, np.zeros((3, n))) is None


@pytest.mark.parametrize("name", ["msm", "twed"])
@pytest.mark.parametrize("scale", [0.125, 0.2, 1.0])
def test_nearest_measures_few_pairs_in_full(spark, name, scale):
    from corvane.operators import distances as D

    x = np.random.default_rng(3).normal(size=(200, 64)) * scale
    x[31], x[41] = x[30], x[40] + 1e-11
    measure = E.DISTANCES[name]
    d = np.round(measure(np.repeat(x, 200, 0), np.tile(x, (200, 1))).reshape(200, 200), 9)
    own = np.eye(200, dtype=bool)
    d[own] = np.inf
    want = {(i, r + 1): (int(c), d[i, c]) for i in range(200) for r, c in enumerate(np.lexsort((np.arange(200), d[i]))[:2])}
    row, col = D.may_be_nearest(*E.straight(measure, x, x), own, 2, lambda i, j: d[i, j])
    assert {(i, c) for (i, _), (c, _) in want.items()} <= set(zip(row.tolist(), col.tolist(), strict=True))
    assert scale == 1 or len(row) < 200 * 16  # wide steps leave more
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)], "id long, s array<double>").coalesce(1)
    assert {(r.q, r["rank"]): (r.c, r.distance) for r in D.nearest(rows, rows, 2, distance=measure).collect()} == want
