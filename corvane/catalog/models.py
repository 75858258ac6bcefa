"""Queries of models: every fifth series is a test row, the others train."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.models import clusterers as C
from corvane.models import dictionary as D
from corvane.models import features as T
from corvane.models import neighbours as N
from corvane.operators import batch as B
from corvane.operators import elastic
from corvane.registry import instances, query

SPLIT = "WITH b AS (SELECT vec_id AS id, label, [CAST(x AS DOUBLE) for x in embedding] AS s FROM embeddings), te AS (SELECT * FROM b WHERE id % 5 = 0), tr AS (SELECT * FROM b WHERE id % 5 <> 0)"


def rows(spark, sf_dir) -> DataFrame:
    return instances(spark, sf_dir).withColumnRenamed("series_id", "id")


def split(spark, sf_dir, every: int = 5) -> tuple[DataFrame, DataFrame]:
    r = rows(spark, sf_dir)
    return r.where(F.col("id") % every != 0), r.where(F.col("id") % every == 0)


PAIRS = ", d AS (SELECT te.id AS q, tr.id AS c, tr.label, ROUND(list_sum([(te.s[i] - tr.s[i]) * (te.s[i] - tr.s[i]) for i in range(1, 65)]), 9) AS d FROM te, tr)"
query("knn_fit_predict", SPLIT + PAIRS + ", n AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY d, c) AS i FROM d), v AS (SELECT q, label, count(*) AS votes FROM n WHERE i <= 3 GROUP BY 1, 2) SELECT q AS id, label AS predicted, votes FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) = 1")(lambda s, d: N.KNN(3).fit(split(s, d)[0]).predict(split(s, d)[1]))
_STEPS = "sqrt(list_sum([pow({0}.s[i + 1] - {0}.s[i], 2) for i in range(1, 64)]))"
_X, _Y = _STEPS.format("te"), _STEPS.format("tr")
query("one_nn_cid", SPLIT + f", d AS (SELECT te.id AS q, tr.id AS c, tr.label, ROUND(list_sum([(te.s[i] - tr.s[i]) * (te.s[i] - tr.s[i]) for i in range(1, 65)]) * greatest({_X}, {_Y}) / least({_X}, {_Y}), 9) AS d FROM te, tr) SELECT q AS id, label AS predicted FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, c) = 1")(lambda s, d: N.one_nn("cid").fit(split(s, d)[0]).predict(split(s, d)[1]).drop("votes"))
for _n in ("dtw", "wdtw", "ddtw", "erp", "lcss", "msm", "twed", "pdtw"):
    query(f"one_nn_{_n}")(lambda s, d, n=_n: N.one_nn(n).fit(split(s, d, 20)[0]).predict(split(s, d, 20)[1]).drop("votes"))
query("one_nn_dtw_window")(lambda s, d: N.one_nn("dtw", window=0.1).fit(split(s, d, 20)[0]).predict(split(s, d, 20)[1]).drop("votes"))
query("one_nn_shape_dtw")(lambda s, d: N.KNN(1, N.shape_distance(lambda w: B.slopes(w, 5), 20)).fit(split(s, d, 40)[0]).predict(split(s, d, 40)[1]).drop("votes"))

BOP = ", w AS (SELECT id, label, s[i + 1:i + 10] AS w FROM b, range(0, 55) r(i)), z AS (SELECT id, label, [CASE WHEN v < 1e-6 THEN 0.0 ELSE (x - m) / sqrt(v) END for x in w] AS z FROM (SELECT *, list_avg([(x - m) * (x - m) for x in w]) AS v FROM (SELECT *, list_avg(w) AS m FROM w))), f AS (SELECT id, label, [list_sum([z[j + 1] * greatest(0.0, least(j + 1.0, (i + 1) * 2.5) - greatest(j + 0.0, i * 2.5)) for j in range(0, 10)]) / 2.5 for i in range(0, 4)] AS p FROM z), l AS (SELECT id, label, array_to_string([substr('abcd', 1 + (x >= -0.67)::INT + (x >= 0.0)::INT + (x >= 0.67)::INT, 1) for x in p], '') AS word FROM f), bag AS (SELECT id, label, word, count(*) AS n FROM l GROUP BY 1, 2, 3)"
query("bag_of_patterns_1nn", SPLIT + BOP + ", q AS (SELECT id, sum(n * n) AS nn FROM bag GROUP BY 1), d AS (SELECT a.id AS q, b.id AS c, b.label, sum(a.n * b.n) AS dot FROM bag a JOIN bag b USING (word) WHERE a.id % 5 = 0 AND b.id % 5 <> 0 GROUP BY 1, 2, 3) SELECT d.q AS id, label AS predicted FROM d JOIN q x ON x.id = d.q JOIN q y ON y.id = d.c QUALIFY row_number() OVER (PARTITION BY d.q ORDER BY x.nn + y.nn - 2 * dot, c) = 1")(lambda s, d: D.bag_of_patterns_1nn(*split(s, d)))
VSM = BOP + ", tf AS (SELECT label, word, sum(n) AS tf FROM bag WHERE id % 5 <> 0 GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), v AS (SELECT label, word, ln(1 + tf) * ln((SELECT count(DISTINCT label) FROM tr) / df::DOUBLE) AS w FROM tf JOIN df USING (word)), sim AS (SELECT bag.id, v.label, sum(n * w) / sqrt(max(nn) * max(ww)) AS similarity FROM bag JOIN v USING (word) JOIN (SELECT id, sum(n * n) AS nn FROM bag GROUP BY 1) o ON o.id = bag.id JOIN (SELECT label, sum(w * w) AS ww FROM v GROUP BY 1) c ON c.label = v.label WHERE bag.id % 5 = 0 AND w > 0 GROUP BY 1, 2)"
query("sax_vsm", SPLIT + VSM + " SELECT id, label AS predicted, ROUND(similarity, 6) + 0.0 AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY id ORDER BY ROUND(similarity, 9) DESC, label) = 1")(lambda s, d: D.SaxVsm().fit(split(s, d)[0]).predict(split(s, d)[1]).withColumn("similarity", F.round("similarity", 6) + 0.0))
query("histogram_intersection", SPLIT + BOP + " SELECT a.id AS q, b.id AS c, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM bag a JOIN bag b USING (word) WHERE a.id % 100 = 0 AND b.id <> a.id GROUP BY 1, 2")(lambda s, d: D.histogram_intersection(D.bags(rows(s, d).where("id % 100 = 0")), D.bags(rows(s, d))))
query("boss_distance", SPLIT + BOP + ", o AS (SELECT id, sum(n * n) AS nn FROM bag GROUP BY 1) SELECT a.id AS q, b.id AS c, CAST(max(nn) + sum(b.n * b.n - 2 * a.n * b.n) AS BIGINT) AS distance FROM bag a JOIN bag b USING (word) JOIN o ON o.id = a.id WHERE a.id % 100 = 0 AND b.id <> a.id GROUP BY 1, 2")(lambda s, d: D.boss_distance(D.bags(rows(s, d).where("id % 100 = 0")), D.bags(rows(s, d))))

query("time_series_forest")(lambda s, d: T.time_series_forest(32, trees=20).fit(split(s, d)[0]).predict(split(s, d)[1]))
query("spectral_forest")(lambda s, d: T.spectral_forest(4, trees=20).fit(split(s, d)[0]).predict(split(s, d)[1]))
query("canonical_forest")(lambda s, d: T.canonical_forest(2, trees=20).fit(split(s, d)[0]).predict(split(s, d)[1]))
query("canonical_forest_views")(lambda s, d: T.canonical_forest(1, True, trees=20).fit(split(s, d)[0]).predict(split(s, d)[1]))
query("catch22_forest")(lambda s, d: T.catch22_forest(trees=20).fit(split(s, d)[0]).predict(split(s, d)[1]))
query("rocket_ridge")(lambda s, d: T.rocket_classifier(split(s, d)[0], 10, 100).predict(split(s, d)[1]).select("id", "predicted"))
query("arsenal")(lambda s, d: T.arsenal(*split(s, d), 10, 3, 50))
query("ridge_raw")(lambda s, d: T.Ridge(lambda x: x).fit(split(s, d)[0], 10).predict(split(s, d)[1]).select("id", "predicted"))

query("k_means")(lambda s, d: C.k_means(rows(s, d), 10)[1].select("id", "cluster", F.round("distance", 6).alias("distance")))
query("farthest_first")(lambda s, d: C._assigned(rows(s, d), C.farthest_first(rows(s, d), 5)).select("id", "cluster", F.round("distance", 6).alias("distance")))
query("k_medoids")(lambda s, d: C.k_medoids(rows(s, d), 5, elastic.euclidean, 5)[1])
query("x_means")(lambda s, d: C.x_means(rows(s, d), 2, 4)[1].select("id", "cluster", F.round("distance", 6).alias("distance")))
RADIUS = 1.2
NEAR = f"WITH b AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) for x in embedding] AS s FROM embeddings), d AS (SELECT x.id AS a, y.id AS b, list_sum([(x.s[i] - y.s[i]) * (x.s[i] - y.s[i]) for i in range(1, 65)]) AS d FROM b x JOIN b y ON x.id <> y.id)"
query("density_peaks", NEAR + f", r AS (SELECT id, count(a) AS density FROM b LEFT JOIN (SELECT a FROM d WHERE d <= {RADIUS}) n ON n.a = b.id GROUP BY 1) SELECT x.id, x.density, ROUND(coalesce(min(d) FILTER (WHERE y.density > x.density OR (y.density = x.density AND y.id < x.id)), max(d)), 6) AS separation FROM r x JOIN d ON d.a = x.id JOIN r y ON y.id = d.b GROUP BY 1, 2")(lambda s, d: C.density_peaks(rows(s, d), RADIUS).withColumn("separation", F.round("separation", 6)))
query("db_scan", NEAR + f", n AS (SELECT a, b FROM d WHERE d <= {RADIUS}), c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) + 1 >= 4), e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)), w AS (WITH RECURSIVE w(id, root) AS (SELECT id, id FROM c UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY 1), o AS (SELECT n.a AS id, min(root) AS border FROM n JOIN w ON w.id = n.b GROUP BY 1) SELECT b.id, coalesce(root, border) AS cluster FROM b LEFT JOIN w USING (id) LEFT JOIN o USING (id)")(lambda s, d: C.db_scan(rows(s, d), RADIUS, 4))
