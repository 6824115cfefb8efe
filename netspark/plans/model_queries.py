"""Preprocessing, models and their evaluation."""

from pyspark.sql import functions as F

from netspark.ml import detector as det
from netspark.ml import preprocess, reduce
from netspark.ml.sequence import SequenceDetector
from netspark.plans.components_sql import component_ctes, projected
from netspark.plans.forest_sql import VERDICT, forest_ctes
from netspark.plans.registry import query
from netspark.session import cut_lineage, scratch_path

_EMB = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings)"
_EMB_WITH_LABEL = """e AS (SELECT vec_id AS id, label,
  list_append(CAST(embedding AS DOUBLE[]), CAST(label AS DOUBLE)) AS features FROM embeddings)"""
_LONG = (
    "l AS (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS position FROM e)"
)


def embeddings(inputs):
    return inputs.table("embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


_NUMERIC = ["length", "src_port", "dst_port", "ttl", "tcp_flags"]
_FILLED = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM packets)) AS {c}" for c in _NUMERIC)
_ZSCORES = ", ".join(
    f"({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END)"
    f" AS z_{c}"
    for c in _NUMERIC
)


@query(
    "preprocess_transform",
    oracle=f"""WITH f AS (SELECT packet_id, coalesce(protocol, 'unknown') AS protocol, {_FILLED} FROM packets)
      SELECT packet_id, {_ZSCORES}, CAST(protocol = 'DNS' AS DOUBLE) AS is_dns,
        CAST(protocol = 'UDP' AS DOUBLE) AS is_udp FROM f""",
    floats=" ".join(f"z_{c}" for c in _NUMERIC),
)
def preprocess_transform(inputs):
    """Numbers imputed and scaled, the protocol one-hot (alphabetical: DNS first, UDP last)."""
    packets = inputs.view("packets").drop("attack_type")
    model = preprocess.fit_preprocessor(packets, numeric=_NUMERIC, categorical=["protocol"])
    done = preprocess.apply_preprocessor(model, packets)
    numbers = [F.col("features")[i].alias(f"z_{c}") for i, c in enumerate(_NUMERIC)]
    return done.select(
        "packet_id", *numbers, F.col("features")[5].alias("is_dns"), F.col("features")[9].alias("is_udp")
    )


@query(
    "standard_scale",
    oracle=f"""WITH {_EMB}, {_LONG} SELECT id, position, (x - avg(x) OVER p) /
        (CASE WHEN stddev_pop(x) OVER p = 0 THEN 1 ELSE stddev_pop(x) OVER p END) AS z
      FROM l WINDOW p AS (PARTITION BY position)""",
    floats="z",
)
def standard_scale(inputs):
    df = embeddings(inputs)
    scaled = df.select("id", preprocess.Scaler.fit(df).column(F.col("features")).alias("z"))
    return scaled.select("id", F.posexplode("z").alias("position", "z")).select(
        "id", F.col("position").cast("bigint").alias("position"), "z"
    )


@query(
    "feature_variance",
    oracle=f"""WITH {_EMB}, {_LONG} SELECT position, avg(x) AS mean, var_samp(x) AS variance FROM l
               GROUP BY position""",
    floats="mean variance",
)
def feature_variance(inputs):
    parts = reduce.variance_parts(embeddings(inputs))
    return parts.withColumn("position", F.col("position").cast("bigint"))


def _scaled(inputs):
    df = embeddings(inputs)
    return df.withColumn("features", preprocess.Scaler.fit(df).column(F.col("features")))


@query(
    "pca_variance",
    oracle=f"""WITH RECURSIVE {_EMB}, {_LONG},
      z AS (SELECT id, position, (x - avg(x) OVER p) / stddev_pop(x) OVER p AS z FROM l
            WINDOW p AS (PARTITION BY position)),
      s AS MATERIALIZED (SELECT id, list(z ORDER BY position) AS features FROM z GROUP BY id),
      {component_ctes("s", "len(rest)")},
      shares AS (SELECT component, vector, eigenvalue / sum(eigenvalue) OVER () AS share,
          sum(eigenvalue) OVER (ORDER BY component) / sum(eigenvalue) OVER () AS reached FROM components),
      kept AS (SELECT * FROM shares WHERE reached - share <= {det.PCA_VARIANCE})
      SELECT id, (SELECT CAST(count(*) AS INT) FROM kept) AS components, (SELECT sum(share) FROM kept) AS explained,
        sqrt(sum(pow(list_dot_product(features, vector), 2))) AS norm
      FROM s CROSS JOIN kept GROUP BY id""",
    floats="explained norm",
)
def pca_variance(inputs):
    """Components that explain 95 % of the variance, their share, and each row's length among them."""
    df = _scaled(inputs)
    fitted = reduce.Projection.fit(df, variance=det.PCA_VARIANCE)
    total = F.lit(float(sum(fitted.explained)))
    row = fitted.column(F.col("features"))
    norm = F.sqrt(F.aggregate("row", F.lit(0.0), lambda total, x: total + x * x))
    return df.select("id", row.alias("row")).select(
        "id", F.size("row").alias("components"), total.alias("explained"), norm.alias("norm")
    )


@query("pca_k", oracle=f"WITH RECURSIVE {_EMB}, {component_ctes('e', '5')} {projected('(SELECT id, features, label FROM e)', 5, ', label')}", floats="PC1 PC2 PC3 PC4 PC5")
def pca_k(inputs):
    df = embeddings(inputs)
    return reduce.Projection.fit(df, k=5).columns(df).drop("features")


@query(
    "select_k_best",
    oracle=f"""WITH {_EMB_WITH_LABEL}, {_LONG}, l2 AS (SELECT * FROM l UNION ALL SELECT id, label, 0.1, (SELECT max(position) + 1 FROM l) FROM e),
        c AS (SELECT position, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l2 GROUP BY position, label
          QUALIFY min(min(x)) OVER (PARTITION BY position) < max(max(x)) OVER (PARTITION BY position)),
        t AS (SELECT position, sum(n * m) / sum(n) AS mean FROM c GROUP BY position),
        g AS (SELECT position, sum(n * (m - mean) * (m - mean)) / (count(*) - 1) AS between_classes,
          sum(n * v) / (sum(n) - count(*)) AS within_classes FROM c JOIN t USING (position) GROUP BY position),
        f AS (SELECT position, CASE WHEN within_classes > 0 THEN between_classes / within_classes
          WHEN between_classes > 0 THEN CAST('Infinity' AS DOUBLE) END AS f_value FROM g)
      SELECT position, f_value FROM f ORDER BY f_value DESC, position LIMIT 10""",
    floats="f_value",
)
def select_k_best(inputs):
    """One more feature separates the classes perfectly, with an infinite F; another is constant and has none."""
    df = embeddings(inputs)
    more = F.array(F.col("label").cast("double"), F.lit(0.1))
    df = df.withColumn("features", F.concat("features", more))
    best = reduce.f_statistics(df).orderBy(F.desc("f_value"), "position").limit(10)
    return best.withColumn("position", F.col("position").cast("bigint"))


def _detected(inputs, model_type, **options):
    df = embeddings(inputs)
    detector = det.AnomalyDetector.fit(df, model_type, **options)
    return detector.transform(df).drop("features", "label")


_FOREST_ON_EMBEDDINGS = f"WITH {_EMB}, {forest_ctes('e', 'e')} SELECT {VERDICT} FROM forest_scores"


@query("isolation_forest", oracle=_FOREST_ON_EMBEDDINGS, floats="anomaly_score")
def isolation_forest(inputs):
    return _detected(inputs, det.FOREST, use_pca=False)


@query("isolation_forest_reduced", floats="anomaly_score")
def isolation_forest_reduced(inputs):
    """On the components that explain 95 % of the variance."""
    return _detected(inputs, det.FOREST)


@query("one_class_svm", floats="anomaly_score")
def one_class_svm(inputs):
    return _detected(inputs, det.BOUNDARY)


@query(
    "local_outlier_factor",
    oracle=f"""WITH {_EMB},
      d AS (SELECT a.id, b.id AS o, round(list_distance(a.features, b.features), 12) AS dist
            FROM e a JOIN e b ON a.id <> b.id),
      k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, o) <= 20),
      r AS (SELECT id, max(dist) AS k_distance FROM k GROUP BY id),
      lrd AS (SELECT k.id, 1 / (avg(greatest(dist, k_distance)) + 1e-10) AS lrd
              FROM k JOIN r ON r.id = k.o GROUP BY k.id)
      SELECT k.id, max(r.k_distance) AS k_distance, max(own.lrd) AS lrd, -avg(near.lrd) / max(own.lrd) AS raw
      FROM k JOIN lrd near ON near.id = k.o JOIN lrd own ON own.id = k.id JOIN r ON r.id = k.id GROUP BY k.id""",
    floats="k_distance lrd raw",
)
def local_outlier_factor(inputs):
    """Training factors on the raw vectors."""
    from netspark.ml.outlier_factor import OutlierFactor

    rows = embeddings(inputs).select("id", F.col("features").alias("vector"))
    return OutlierFactor.fit(rows).known


@query(
    "lof_novelty",
    oracle=f"""WITH {_EMB}, {_LONG},
      z AS (SELECT id, position, (x - avg(x) OVER p) / stddev_pop(x) OVER p AS z FROM l
            WINDOW p AS (PARTITION BY position)),
      s AS (SELECT id, list(z ORDER BY position) AS features FROM z GROUP BY id),
      d AS (SELECT a.id, b.id AS o, round(list_distance(a.features, b.features), 12) AS dist
            FROM s a CROSS JOIN s b),
      k AS (SELECT * FROM d WHERE id <> o QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, o) <= 20),
      r AS (SELECT id, max(dist) AS k_distance FROM k GROUP BY id),
      lrd AS (SELECT k.id, 1 / (avg(greatest(dist, k_distance)) + 1e-10) AS lrd
              FROM k JOIN r ON r.id = k.o GROUP BY k.id),
      n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, o) <= 20),
      own AS (SELECT n.id, 1 / (avg(greatest(dist, k_distance)) + 1e-10) AS lrd
              FROM n JOIN r ON r.id = n.o GROUP BY n.id),
      f AS (SELECT n.id, 1.5 - avg(lrd.lrd) / max(own.lrd) AS anomaly_score
            FROM n JOIN lrd ON lrd.id = n.o JOIN own ON own.id = n.id GROUP BY n.id)
      SELECT id, anomaly_score, CASE WHEN anomaly_score < 0 THEN -1 ELSE 1 END AS prediction,
        anomaly_score < 0 AS is_anomaly FROM f""",
    floats="anomaly_score",
)
def lof_novelty(inputs):
    """Scaled rows scored against all of them, as new rows are."""
    return _detected(inputs, det.FACTOR, use_pca=False)


@query("ensemble_detect", floats="anomaly_score")
def ensemble_detect(inputs):
    return _detected(inputs, det.ENSEMBLE)


@query(
    "ensemble_vote",
    oracle="""WITH s AS (SELECT packet_id, anomaly_score AS s1, anomaly_score + 0.25 AS s2,
          (packet_id % 7 - 3) / 10.0e0 AS s3 FROM detections)
      SELECT packet_id, CAST(sign(CASE WHEN s1 < 0 THEN -1 ELSE 1 END + CASE WHEN s2 < 0 THEN -1 ELSE 1 END
        + CASE WHEN s3 < 0 THEN -1 ELSE 1 END) AS INT) AS prediction, (s1 + s2 + s3) / 3 AS score FROM s""",
    floats="score",
)
def ensemble_vote(inputs):
    scores = inputs.view("detections").select(
        "packet_id",
        F.col("anomaly_score").alias("s1"),
        (F.col("anomaly_score") + 0.25).alias("s2"),
        ((F.col("packet_id") % 7 - 3) / 10.0).alias("s3"),
    )
    label = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    mean = (F.col("s1") + F.col("s2") + F.col("s3")) / 3
    votes = det.vote(label("s1"), label("s2"), label("s3"))
    return scores.select("packet_id", votes.alias("prediction"), mean.alias("score"))


@query(
    "contamination_threshold",
    oracle="""WITH o AS (SELECT quantile_cont(anomaly_score, 0.25) AS cut FROM detections)
      SELECT packet_id, anomaly_score, anomaly_score < cut AS is_anomaly FROM detections CROSS JOIN o""",
)
def contamination_threshold(inputs):
    scored = inputs.view("detections").select("packet_id", "anomaly_score")
    cut = det.contamination_offset(scored, "anomaly_score", 0.25)
    return scored.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(cut))


_PROTOCOLS = "(SELECT DISTINCT protocol FROM f)"
PACKET_FEATURES = f"""f AS MATERIALIZED (SELECT packet_id, coalesce(protocol, 'unknown') AS protocol, {_FILLED} FROM packets),
  o AS (SELECT packet_id, list(CAST(f.protocol = p.protocol AS DOUBLE) ORDER BY p.protocol) AS hot
        FROM f CROSS JOIN {_PROTOCOLS} p GROUP BY packet_id),
  e AS MATERIALIZED (SELECT packet_id AS id,
        list_concat([{", ".join(f"CAST({c} AS DOUBLE)" for c in _NUMERIC)}], hot) AS features FROM f JOIN o USING (packet_id))"""


@query(
    "predict_score",
    oracle=f"WITH {PACKET_FEATURES}, {forest_ctes('e', 'e', 0.25)} SELECT {VERDICT} FROM forest_scores",
    floats="anomaly_score",
)
def predict_score(inputs):
    """Per-packet scoring with the preprocessing of the packet table."""
    packets = inputs.view("packets")
    model = preprocess.fit_preprocessor(packets, numeric=_NUMERIC, categorical=["protocol"])
    df = preprocess.apply_preprocessor(model, packets).withColumnRenamed("packet_id", "id")
    rows = cut_lineage(df.select("id", "features"))
    detector = det.AnomalyDetector.fit(rows, det.FOREST, use_pca=False, contamination=0.25)
    return detector.transform(rows).drop("features")


@query(
    "train_test_split",
    oracle="""SELECT vec_id AS id, label, CASE WHEN CAST('0x' || substr(md5(concat(vec_id, '-42')), 1, 7) AS BIGINT) % 100
        >= 20 THEN 'train' ELSE 'test' END AS part FROM embeddings""",
)
def train_test_split(inputs):
    train, test = det.hash_split(embeddings(inputs).select("id", "label"))
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query("save_load_model", oracle=_FOREST_ON_EMBEDDINGS, floats="anomaly_score")
def save_load_model(inputs):
    """Scores of a detector that went through the shared folder."""
    df = embeddings(inputs)
    path = scratch_path(inputs.spark, "model")
    det.AnomalyDetector.fit(df, det.FOREST, use_pca=False).save(inputs.spark, path)
    loaded = det.AnomalyDetector.load(inputs.spark, path)
    return loaded.transform(df).drop("features", "label")


_RUN_FEATURES = ["length", "src_port", "dst_port", "ttl"]
_RUN_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in _RUN_FEATURES)


@query(
    "sequence_anomaly",
    oracle=f"""WITH RECURSIVE f AS (SELECT packet_id, src_ip, timestamp, [{_RUN_Z}] AS x FROM packets),
      h AS (SELECT packet_id, list(x) OVER (PARTITION BY src_ip ORDER BY timestamp, packet_id ROWS 9 PRECEDING) AS h
            FROM f WHERE src_ip IS NOT NULL),
      runs AS MATERIALIZED (SELECT packet_id AS id, flatten(h) AS features FROM h WHERE len(h) = 10),
      {component_ctes("runs", "8")},
      c AS (SELECT id, list_transform(features, lambda x, i : x - mean[i]) AS c FROM runs CROSS JOIN pc_mean),
      r AS (SELECT id, (any_value(list_dot_product(c, c)) - sum(pow(list_dot_product(c, vector), 2))) / any_value(len(c))
            AS error FROM c CROSS JOIN components GROUP BY id),
      q AS (SELECT quantile_cont(error, 0.95) AS cut FROM r)
      SELECT packet_id, src_ip, coalesce(-error, 0) AS anomaly_score, CASE WHEN error > cut THEN -1 ELSE 1 END AS prediction
      FROM packets LEFT JOIN r ON id = packet_id CROSS JOIN q""",
    floats="anomaly_score",
)
def sequence_anomaly(inputs):
    packets = inputs.view("packets")
    _, found = SequenceDetector.fit_transform(packets, _RUN_FEATURES)
    return found.select("packet_id", "src_ip", "anomaly_score", "prediction")


@query(
    "projection_2d",
    oracle=f"""WITH RECURSIVE {_EMB}, {component_ctes("e", "2")}, {forest_ctes("e", "e")},
      x AS ({projected("e", 2)}), y AS (SELECT {VERDICT} FROM forest_scores)
      SELECT id, PC1, PC2, anomaly_score, prediction FROM x JOIN y USING (id)""",
    floats="PC1 PC2 anomaly_score",
)
def projection_2d(inputs):
    """Two components with the detector's verdict, for a scatter plot."""
    df = embeddings(inputs)
    scored = det.AnomalyDetector.fit(df, det.FOREST, use_pca=False).transform(df)
    flat = reduce.Projection.fit(df, k=2).columns(scored)
    return flat.select("id", "PC1", "PC2", "anomaly_score", "prediction")


_BUCKET = "CAST('0x' || substr(md5(concat(vec_id, '-42')), 1, 7) AS BIGINT) % 100"
_SPLIT = f"""w AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features,
    CASE WHEN label = 0 THEN -1 ELSE 1 END AS label, {_BUCKET} >= 20 AS train FROM embeddings),
  a AS MATERIALIZED (SELECT id, features FROM w WHERE train),
  b AS MATERIALIZED (SELECT id, features FROM w WHERE NOT train)"""


@query(
    "train_evaluate_job",
    oracle=f"""WITH {_SPLIT}, {forest_ctes("a", "b", 0.1)},
      v AS (SELECT label > 0 AS truth, anomaly_score >= 0 AS guess, anomaly_score
            FROM forest_scores JOIN w USING (id)),
      c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE truth AND guess) AS tp,
              count(*) FILTER (WHERE NOT truth AND guess) AS fp, count(*) FILTER (WHERE truth AND NOT guess) AS fn,
              count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn, avg(anomaly_score) AS mean_score,
              min(anomaly_score) AS min_score, max(anomaly_score) AS max_score FROM v)
      SELECT coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy,
        coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
        coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
        coalesce(tp * 2 / nullif(CAST(tp * 2 + fp + fn AS DOUBLE), 0), 0) AS f1_score,
        coalesce((fn + tn) / nullif(n, 0), 0) AS anomaly_ratio, mean_score, min_score, max_score FROM c""",
    floats="accuracy precision recall f1_score anomaly_ratio mean_score min_score max_score",
)
def train_evaluate_job(inputs):
    """Split, train, save, load, score the held-out rows and evaluate; one row of metrics."""
    from netspark.plans.jobs import train_and_evaluate

    labelled = embeddings(inputs).withColumn(
        "label", F.when(F.col("label") == 0, -1).otherwise(1)
    )
    path = scratch_path(inputs.spark, "trained")
    metrics = train_and_evaluate(labelled, path, model_type=det.FOREST, use_pca=False, contamination=0.1)
    return cut_lineage(metrics)
