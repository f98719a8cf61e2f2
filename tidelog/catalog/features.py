"""Queries over vectors and scores: features, images, classification measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.catalog import views as v
from tidelog.catalog.registry import joined, query, r6
from tidelog.catalog.views import with_views
from tidelog.functions import scores as sc
from tidelog.functions import vectors as vec
from tidelog.operators.mergeable import CalibrationError, MacroF1, evaluate_mergeable
from tidelog.operators.train import FeedForward, prediction_grid, score
from tidelog.schemas import Payload
from tidelog.sources.decode import decode
from tidelog.sources.images import gray_pixels, gray_unit

E6 = "CAST(round(CAST({} AS DOUBLE) * 1000000) AS BIGINT)"
# One row per vector element: id, position i and value v.
ELEMENTS = """SELECT id, i, x[i + 1] AS v FROM (SELECT id, x, unnest(range(0, len(x))) AS i FROM sample_vec)"""


def e6(col):
    return F.round(col.cast("double") * 1e6).cast("bigint")


def elements(df, col="x", name="v_e6", *keep):
    return df.select("id", *keep, F.posexplode(col).alias("i", "_v")).select("id", *keep, "i", e6(F.col("_v")).alias(name))


@query(
    "reshape_chw",
    with_views(
        f"""SELECT id, CAST(i // 64 AS INTEGER) AS c, CAST(i % 64 // 8 AS INTEGER) AS h, CAST(i % 8 AS INTEGER) AS w,
                   {E6.format("v")} AS v_e6 FROM ({ELEMENTS})""",
        "sample_vec",
    ),
)
def reshape(spark, sf_dir):
    return (
        v.sample_vec(spark, sf_dir)
        .select("id", F.posexplode(vec.reshape_chw(F.col("x"), (1, 8, 8))).alias("c", "plane"))
        .select("id", "c", F.posexplode("plane").alias("h", "line"))
        .select("id", "c", "h", F.posexplode("line").alias("w", "_v"))
        .select("id", "c", "h", "w", e6(F.col("_v")).alias("v_e6"))
    )


def ragged(spark, sf_dir):
    """Every fifth vector lacks its last value."""
    cut = F.when(F.col("id") % 5 == 0, F.slice("x", 1, 63)).otherwise(F.col("x"))
    return v.sample_vec(spark, sf_dir).withColumn("x", cut)


@query(
    "conditional_reshape",
    """SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN '63' ELSE '1,8,8' END AS shape,
              CASE WHEN vec_id % 5 = 0 THEN 63 ELSE 64 END AS n FROM embeddings""",
)
def conditional(spark, sf_dir):
    shaped = ragged(spark, sf_dir).withColumn("t", vec.conditional_reshape(F.col("x"), (1, 8, 8)))
    return shaped.select("id", F.array_join("t.shape", ",").alias("shape"), F.size("t.x").alias("n"))


BYTE = "least(255, greatest(0, CAST(floor((CAST({} AS DOUBLE) + 1) * 127) AS INTEGER)))"


def byte_vec(spark, sf_dir):
    as_byte = F.transform(
        "x", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127).cast("int")))
    )
    return v.sample_vec(spark, sf_dir).select("id", as_byte.alias("x"))


@query(
    "scale_bytes",
    with_views(f"SELECT id, CAST(i AS INTEGER) AS i, {E6.format('CAST(' + BYTE.format('v') + ' AS FLOAT) / CAST(255 AS FLOAT)')} AS v_e6 FROM ({ELEMENTS})", "sample_vec"),
)
def scale(spark, sf_dir):
    return elements(byte_vec(spark, sf_dir).withColumn("x", vec.scale_bytes(F.col("x"))))


STANDARD = "(v - CAST({} AS FLOAT)) / CAST({} AS FLOAT)"


@query(
    "normalize",
    with_views(
        f"SELECT id, CAST(i AS INTEGER) AS i, {E6.format(STANDARD.format(0.1307, 0.3081))} AS v_e6 FROM ({ELEMENTS})",
        "sample_vec",
    ),
)
def normalize(spark, sf_dir):
    return elements(v.sample_vec(spark, sf_dir).withColumn("x", vec.normalize(F.col("x"))))


@query(
    "normalize_channels",
    with_views(
        f"""SELECT id, CAST(i AS INTEGER) AS i,
                   {E6.format(STANDARD.format("[0.1, 0.2, 0.3, 0.4][i // 16 + 1]", "[0.5, 0.6, 0.7, 0.8][i // 16 + 1]"))} AS v_e6
            FROM ({ELEMENTS})""",
        "sample_vec",
    ),
)
def normalize_channels(spark, sf_dir):
    out = vec.normalize(F.col("x"), (0.1, 0.2, 0.3, 0.4), (0.5, 0.6, 0.7, 0.8), plane=16)
    return elements(v.sample_vec(spark, sf_dir).withColumn("x", out))


@query(
    "batch_transform",
    with_views(
        f"""SELECT id // 32 AS batch_id, id, CAST(i AS INTEGER) AS i, {E6.format(STANDARD.format(0.1307, 0.3081))} AS v_e6
            FROM ({ELEMENTS})""",
        "sample_vec",
    ),
)
def batch_transform(spark, sf_dir):
    batches = (
        v.sample_vec(spark, sf_dir)
        .groupBy(F.expr("id div 32").alias("batch_id"))
        .agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("rows"))
    )
    images = vec.transform_batch(F.col("rows.x"), vec.normalize)
    flat = batches.select("batch_id", F.explode(F.arrays_zip(F.col("rows.id").alias("id"), images.alias("x"))).alias("s"))
    return elements(flat.select("batch_id", "s.id", "s.x"), "x", "v_e6", "batch_id")


@query(
    "shape_check",
    "SELECT vec_id AS id, vec_id % 5 <> 0 AS ok FROM embeddings",
)
def shape_check(spark, sf_dir):
    return ragged(spark, sf_dir).select("id", vec.has_shape(F.col("x"), (1, 8, 8)).alias("ok"))


@query(
    "label_transform",
    with_views(
        'SELECT "partition", "offset", round(x0 / 100, 6) AS x0, round(x1 / 100, 6) AS x1, upper(y) AS y FROM message_log',
        "message_log",
    ),
)
def label_transform(spark, sf_dir):
    payload = Payload(
        "none",
        transform_data=lambda x: F.transform(x, lambda e: e / 100),
        transform_label=F.upper,
    )
    return decode(v.message_log(spark, sf_dir), payload).select(
        "partition", "offset", r6(F.get("x", F.lit(0)), "x0"), r6(F.get("x", F.lit(1)), "x1"), "y"
    )


PIXELS = f"SELECT id, list_transform(x, lambda e: {BYTE.format('e')}) || [0, 0] AS b FROM sample_vec"


@query(
    "image_gray",
    with_views(
        f"""SELECT id, CAST(p AS INTEGER) AS i, gray, CAST(round(CAST(CAST(gray / CAST(255 AS DOUBLE) AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT) AS x_e6
            FROM (SELECT id, p, (b[3 * p + 3] * 19595 + b[3 * p + 2] * 38470 + b[3 * p + 1] * 7471 + 32768) // 65536 AS gray
                  FROM (SELECT id, b, unnest(range(0, 22)) AS p FROM ({PIXELS})))""",
        "sample_vec",
    ),
)
def image_gray(spark, sf_dir):
    """Vectors of 64 values read as 1 x 22 images of three bytes per pixel, the last one filled up with zeros."""
    as_hex = F.transform(F.concat("x", F.array(F.lit(0), F.lit(0)).cast("array<int>")), lambda b: F.lpad(F.hex(b), 2, "0"))
    images = byte_vec(spark, sf_dir).select("id", F.unhex(F.array_join(as_hex, "")).alias("data"), F.lit(3).alias("n"))
    both = images.select(
        "id",
        F.arrays_zip(
            gray_pixels(F.col("data"), F.col("n")).alias("gray"), gray_unit(F.col("data"), F.col("n")).alias("x")
        ).alias("p"),
    )
    return both.select("id", F.posexplode("p").alias("i", "s")).select("id", "i", "s.gray", e6(F.col("s.x")).alias("x_e6"))


EXPS = "SELECT id, target, scores, list_transform(scores, lambda s: exp(s - list_max(scores))) AS e FROM scores"
RANKED = """
    SELECT *, len(list_filter(range(1, len(scores) + 1),
                  lambda i: scores[i] > scores[target + 1] OR (scores[i] = scores[target + 1] AND i < target + 1))) AS better,
           list_position(scores, list_max(scores)) - 1 AS pred FROM scores"""


@query(
    "softmax",
    with_views(
        f"""SELECT id, CAST(i AS INTEGER) AS i, {E6.format("e[i + 1] / list_sum(e)")} AS v_e6
            FROM (SELECT *, unnest(range(0, len(scores))) AS i FROM ({EXPS}))""",
        "scores",
    ),
)
def softmax(spark, sf_dir):
    return elements(v.scores(spark, sf_dir).select("id", sc.softmax(F.col("scores")).alias("x")))


@query(
    "log_softmax",
    with_views(
        f"""SELECT id, CAST(i AS INTEGER) AS i, {E6.format("ln(e[i + 1] / list_sum(e))")} AS v_e6
            FROM (SELECT *, unnest(range(0, len(scores))) AS i FROM ({EXPS}))""",
        "scores",
    ),
)
def log_softmax(spark, sf_dir):
    return elements(v.scores(spark, sf_dir).select("id", sc.log_softmax(F.col("scores")).alias("x")))


@query("argmax_class", with_views(f"SELECT id, CAST(pred AS INTEGER) AS pred FROM ({RANKED})", "scores"))
def argmax(spark, sf_dir):
    return v.scores(spark, sf_dir).select("id", sc.argmax_class(F.col("scores")).alias("pred"))


@query(
    "accuracy",
    with_views(f"SELECT round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy FROM ({RANKED})", "scores"),
)
def accuracy(spark, sf_dir):
    return v.scores(spark, sf_dir).agg(r6(sc.accuracy(F.col("scores"), F.col("target")), "accuracy"))


@query(
    "topk_accuracy",
    with_views(
        f"""SELECT round(avg(CASE WHEN better < 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS top1,
                   round(avg(CASE WHEN better < 3 THEN 1.0 ELSE 0.0 END) * 100, 6) AS top3,
                   round(avg(CASE WHEN better < 5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS top5 FROM ({RANKED})""",
        "scores",
    ),
)
def topk(spark, sf_dir):
    s, t = F.col("scores"), F.col("target")
    return v.scores(spark, sf_dir).agg(*[r6(sc.top_k_accuracy(s, t, k), f"top{k}") for k in (1, 3, 5)])


@query(
    "cross_entropy",
    with_views(f"SELECT round(avg(-ln(e[target + 1] / list_sum(e))), 6) AS loss FROM ({EXPS})", "scores"),
)
def cross_entropy(spark, sf_dir):
    return v.scores(spark, sf_dir).agg(r6(sc.cross_entropy(F.col("scores"), F.col("target")), "loss"))


@query(
    "prediction_grid",
    with_views(
        """SELECT id, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred, 8 AS height,
                  array_to_string(list_transform(x, lambda e: CAST(round(CAST(e AS DOUBLE) * 1000000) AS BIGINT)), ',') AS pixels
           FROM scores ORDER BY id LIMIT 40""",
        "scores",
    ),
)
def grid(spark, sf_dir):
    shown = prediction_grid(v.scores(spark, sf_dir), "id", (1, 8, 8))
    plane = F.col("image")[0]
    return shown.select("id", "pred", F.size(plane).alias("height"), joined(F.flatten(plane), "pixels"))


@query(
    "ff_score",
    with_views(
        f"""SELECT id, CAST(c AS INTEGER) AS c, CAST(round(e / sum(e) OVER (PARTITION BY id) * 1000000) AS BIGINT) AS p_e6 FROM (
                SELECT id, c, exp(o - max(o) OVER (PARTITION BY id)) AS e FROM (
                    SELECT id, c, sum(h * sin(j * 0.7::DOUBLE + c * 1.3::DOUBLE + 0.5::DOUBLE)) AS o FROM (
                        SELECT id, j, greatest(sum(v * sin(i * 0.7::DOUBLE + j * 1.3::DOUBLE)), 0) AS h
                        FROM ({ELEMENTS}), range(0, 128) AS hidden(j) GROUP BY id, j), range(0, 10) AS classes(c)
                    GROUP BY id, c))""",
        "sample_vec",
    ),
)
def ff_score(spark, sf_dir):
    network = FeedForward.waves(inputs=64)
    scored = v.sample_vec(spark, sf_dir).select("id", score(F.col("x"), network).alias("p"))
    return elements(scored, "p", "p_e6").withColumnRenamed("i", "c")


@query(
    "metric_mergeable",
    with_views(
        """SELECT part, 'macro F1' AS name, round(avg(2.0 * n_right / (guessed + asked)), 6) AS value FROM (
               SELECT part, c, sum(g) AS guessed, sum(a) AS asked, sum(r) AS n_right FROM (
                   SELECT part, guess AS c, 1 AS g, 0 AS a, CAST(guess = target AS INTEGER) AS r FROM told
                   UNION ALL SELECT part, target, 0, 1, 0 FROM told) GROUP BY part, c) GROUP BY part
           UNION ALL
           SELECT part, 'calibration', round(sum(gap) / sum(n), 6) FROM (
               SELECT part, count(*) AS n, abs(sum(sure) - count(*) FILTER (guess = target)) AS gap FROM told
               GROUP BY part, least(floor(sure * 10), 9)) GROUP BY part""",
        "scores",
        extra={
            "told": """SELECT id % 4 AS part, target, list_position(scores, list_max(scores)) - 1 AS guess,
                              1 / list_sum(list_transform(scores, lambda e: exp(e - list_max(scores)))) AS sure FROM scores"""
        },
    ),
)
def metric_mergeable(spark, sf_dir):
    scored = v.scores(spark, sf_dir).withColumn("part", F.col("id") % 4)
    found = evaluate_mergeable(scored, {"macro F1": MacroF1(64), "calibration": CalibrationError()}, ["part"], label="target")
    return found.select("part", "name", r6("value", "value"))
