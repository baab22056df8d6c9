"""Queries over checks, lookups, shapes and row-wise functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataContractError
from ..functions import dsp
from ..operators import detectors, explain, fingerprints, joins, learning, metrics, training, validate
from ..operators import windows as W
from ..sources import manifest as M
from . import standins as S
from .catalogue import _SUMMARY, _curve_sql, _dcf, _min_dcf_sql, query, rounded, with_views

# --- keys, labels, scores ----------------------------------------------------


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_labels(spark: SparkSession, d: str) -> DataFrame:
    return joins.lookup(S.read(spark, d, "documents").select("doc_id", "lang"), S.read(spark, d, "labels"), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars + 0.5::DOUBLE AS score FROM documents")
def predictions_check(spark: SparkSession, d: str) -> DataFrame:
    """Predictions read as text: ids trimmed, numbers parsed, everything checked."""
    text = S.read(spark, d, "documents").select(F.concat(F.lit("  "), F.col("doc_id"), F.lit(" ")).alias("name"), F.concat(F.col("n_chars"), F.lit(".5")).alias("said"))
    return validate.check_scores(text, "name", "said")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'spoof' ELSE 'bonafide' END AS label FROM labels")
def labels_check(spark: SparkSession, d: str) -> DataFrame:
    text = S.read(spark, d, "labels").select(F.concat(F.col("doc_id"), F.lit(" ")).alias("name"), F.when(F.col("toxic") == 1, " spoof").otherwise("bonafide ").alias("said"))
    return validate.check_labels(text, "name", "said")


@query("SELECT 'l-' || lang AS spelled, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang")
def unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    """Spellings that stand for no class, and how often each occurs."""
    known = F.when(F.col("doc_id") % 2 == 0, "Real ").otherwise("1.0")
    rows = S.read(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, known).otherwise(F.concat(F.lit("l-"), "lang")).alias("spelled"))
    return rows.filter(validate.label_code("spelled").isNull()).groupBy("spelled").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT file_id, CAST(label AS TINYINT) AS label, fold FROM manifest", "manifest"))
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("label") == 1, F.when(F.col("fold") == 0, "Fake").otherwise(" synthetic ")).otherwise(F.when(F.col("fold") == 0, "bona_fide").otherwise("0.0"))
    return validate.check_manifest(S.manifest(spark, d).withColumn("label", spelled).select("file_id", "label", "fold", "lang"))


_LISTED = "string_agg(CASE WHEN k <= 5 THEN '''' || id || '''' END, ', ' ORDER BY id) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END"


@query(with_views(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, doc_id IN (SELECT doc_id FROM labels) AS held FROM documents),
    bad AS (SELECT 'length: missing ids: ' AS said, id FROM d WHERE held AND lang = 'es' UNION ALL SELECT 'length: unknown ids: ', id FROM d WHERE NOT held
      UNION ALL SELECT 'length: duplicate ids: ', id FROM d WHERE held AND lang = 'de'),
    k AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY id) AS k FROM bad)
    SELECT said || {_LISTED} AS message FROM k GROUP BY said
    UNION ALL SELECT 'length: columns of the manifest fold' UNION ALL SELECT 'length: not numeric length' UNION ALL SELECT 'length: features already taken length'
    UNION ALL SELECT 'length: no features' UNION ALL SELECT 'length: duplicate columns length' UNION ALL SELECT 'length: not finite length'""", "manifest"))
def feature_source_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is said of feature sources that do not fit the manifest one to one."""
    man = validate.check_manifest(S.manifest(spark, d).select("file_id", "label", "fold"))
    docs = S.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("n_chars").alias("length"), "lang")
    held = docs.join(man.select("file_id"), "file_id", "left_semi")
    good = held.drop("lang")
    cases = [
        (held.filter("lang <> 'es'").drop("lang"), ()), (docs.drop("lang"), ()), (good.unionByName(held.filter("lang = 'de'").drop("lang")), ()), (good.withColumn("fold", F.lit(1)), ()),
        (good.withColumn("length", F.col("length").cast("string")), ()), (good, ("length",)), (good.select("file_id"), ()), (good.select("*", "length"), ()),
        (good.withColumn("length", F.lit(float("inf"))), ()),
    ]
    said = []
    for source, taken in cases:
        try:
            validate.check_feature_source(source, "length", man, taken)
        except DataContractError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "message string")


@query(f"""WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS k FROM documents WHERE lang = 'en')
    SELECT 'documents: duplicate ids: ' || {_LISTED} AS message FROM k UNION ALL SELECT 'documents: blank ''file_id''' UNION ALL SELECT 'documents: no column ''file_id''' UNION ALL SELECT 'documents: ''file_id'' must be text'""")
def id_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "lang")
    cases = [
        rows.unionByName(rows.filter("lang = 'en'")), rows.withColumn("file_id", F.when(F.col("lang") == "en", " ").otherwise(F.col("file_id"))), rows.drop("file_id"),
        rows.withColumn("file_id", F.col("file_id").cast("long")),
    ]
    said = []
    for df in cases:
        try:
            validate.check_ids(df, "file_id", "documents")
        except DataContractError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "message string")


@query("""SELECT unnest(['no features', 'a feature is chosen twice', '''fold'' is no feature', 'unknown feature ''x''', 'feature ''lang'' is not numeric', 'labels must be 0 or 1', 'both classes are required',
    'blank fold', 'not finite: length', 'chosen: length, doc_id']) AS message""")
def cv_table_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is said of tables that cannot be cross validated, and the features of one that can."""
    rows = S.manifest(spark, d).join(S.read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length")), "doc_id").select("file_id", "label", "fold", "length", "doc_id", "lang")
    plain = rows.drop("lang")
    cases = [
        (plain, []), (plain, ["length", "length"]), (plain, ["fold"]), (plain, ["x"]), (rows, ["lang"]), (plain.withColumn("label", F.col("label") * 2), None), (plain.filter("label = 0"), None),
        (plain.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold"))), None), (plain.withColumn("length", F.lit(float("nan"))), None), (plain, None),
    ]
    said = []
    for df, chosen in cases:
        try:
            said.append(("chosen: " + ", ".join(validate.check_cv_table(df, chosen)),))
        except DataContractError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "message string")


@query(with_views("SELECT count(*) AS n, min(score) AS least, max(score) AS most FROM window_scores", "window_scores"))
def window_score_check(spark: SparkSession, d: str) -> DataFrame:
    return validate.check_window_scores(S.window_scores(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 < 3 THEN n_chars / 4.0::DOUBLE END AS number FROM documents""")
def finite_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from text, null for what is no finite number."""
    i = F.col("doc_id") % 6
    said = F.when(i < 3, (F.col("n_chars") / 4).cast("string")).when(i == 3, "NaN").when(i == 4, "-Infinity").otherwise("about ten")
    return S.read(spark, d, "documents").select("doc_id", validate.finite_or_null(said).alias("number"))


@query("""SELECT vec_id, vec_id % 6 >= 5 AS sounding, vec_id % 6 = 2 OR vec_id % 6 >= 4 AS valid FROM embeddings""")
def waveform_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether embeddings would do as waveforms: 0 a null sample, 1 a NaN, 2 silence, 3 too short, 4 rightly long but silent, 5 whole."""
    i, e = F.col("vec_id") % 6, F.col("embedding")
    x = (
        F.when(i == 0, F.concat(F.slice(e, 1, 40), F.array(F.lit(None).cast("float")))).when(i == 1, F.concat(e, F.array(F.lit(float("nan")).cast("float"))))
        .when((i == 2) | (i == 4), F.transform(e, lambda v: F.lit(0.0).cast("float"))).when(i == 3, F.slice(e, 1, 31)).otherwise(e)
    )
    rows = S.read(spark, d, "embeddings").select("vec_id", x.alias("x"), F.lit(16_000).alias("rate"))
    return rows.select("vec_id", validate.valid_waveform("x", "rate", seconds=0.002, silent=False).alias("sounding"), validate.valid_waveform("x", "rate", seconds=0.002).alias("valid"))


# --- metrics -----------------------------------------------------------------


@query(with_views(f"SELECT min_dcf, threshold, p_miss, p_fa FROM ({_min_dcf_sql('scored').replace('SELECT round(cost', 'SELECT -threshold AS threshold, round(cost').replace(', threshold, round(p_miss', ', round(p_miss')})", "scored"))
def min_dcf_of_points(spark: SparkSession, d: str) -> DataFrame:
    """The least cost on the stored points of the curve; thresholds there are negated scores."""
    curve = metrics.det_curve(S.scored(spark, d), "score", "is_spoof")
    return rounded(metrics.min_dcf_of_curve(curve).drop("unnormalized_cost"), "min_dcf", "p_miss", "p_fa")


@query(with_views(_min_dcf_sql("scored"), "scored"))
def min_dcf_evaluated(spark: SparkSession, d: str) -> DataFrame:
    """minDCF behind the checks of a score vector."""
    return _dcf(metrics.evaluate_min_dcf(S.scored(spark, d), "score", "is_spoof"))


@query("SELECT event_id, round_even(value, 1) AS tenths, round_even(value / 10, 0) AS tens FROM events")
def half_even(spark: SparkSession, d: str) -> DataFrame:
    """Rounding half to even."""
    return S.read(spark, d, "events").select("event_id", F.bround("value", 1).alias("tenths"), F.bround(F.col("value") / 10, 0).alias("tens"))


@query(with_views("""SELECT file_id, label, CASE WHEN label = 1 THEN (SELECT CAST(count(*) FILTER (label = 0) AS DOUBLE) / count(*) FILTER (label = 1) FROM manifest) ELSE 1.0::DOUBLE END AS weight FROM manifest""", "manifest"))
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return learning.class_weights(S.manifest(spark, d).select("file_id", "label"))


@query("SELECT source FROM documents WHERE lang = 'es' UNION SELECT source FROM documents WHERE lang = 'de'")
def all_generators(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents")
    return docs.filter("lang = 'es'").select("source").union(docs.filter("lang = 'de'").select("source")).distinct()


# --- shapes of sample arrays -------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings cut to 1 to 64 samples by their id."""
    return S.read(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("x"))


@query("""SELECT vec_id, p, CAST(embedding[CAST((p - 1) % (vec_id % 64 + 1) + 1 AS BIGINT)] AS DOUBLE) AS repeated, CASE WHEN p <= vec_id % 64 + 1 THEN CAST(embedding[p] AS DOUBLE) ELSE 0.0 END AS filled
    FROM (SELECT vec_id, embedding, unnest(generate_series(1, 40)) AS p FROM embeddings)""")
def fitted_lengths(spark: SparkSession, d: str) -> DataFrame:
    """40 samples of each vector: repeated until they suffice, and filled with zeros."""
    rows = _vectors(spark, d).select("vec_id", F.posexplode(F.arrays_zip(W.repeat_to(F.col("x"), 40).alias("r"), W.fit_length(F.col("x"), 40).alias("f"))).alias("p", "z"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("p"), F.col("z.r").cast("double").alias("repeated"), F.col("z.f").cast("double").alias("filled"))


@query("""WITH k AS (SELECT vec_id, vec_id % 64 + 1 AS n FROM embeddings WHERE vec_id % 64 + 1 >= 15 ORDER BY CAST(vec_id AS VARCHAR) LIMIT 60)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, format('sample_{:06d}.wav', row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1) AS filename, CAST(least(n, 50) AS INTEGER) AS n FROM k""")
def accepted_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 clips of 1.5 s or more at ten samples a second, cut to 5 s and named in sequence."""
    clips = _vectors(spark, d).select(F.col("vec_id").cast("string").alias("file_id"), F.lit(10).alias("sample_rate"), F.col("x").alias("samples"))
    return M.accepted_samples(clips, 60, 1.5, 5.0).select("file_id", "filename", F.size("samples").alias("n"))


_LAYERS = "SELECT label, vec_id % 3 AS layer, dim, CAST(x AS DOUBLE) AS x FROM (SELECT label, vec_id, unnest(generate_series(0, 63)) AS dim, unnest(embedding) AS x FROM embeddings) WHERE vec_id % 5 <> 0"


@query(f"""WITH s AS (SELECT label, layer, dim, avg(x) AS m, sqrt(var_pop(x) + 1e-8::DOUBLE) AS s FROM ({_LAYERS}) GROUP BY ALL)
    SELECT CAST(label AS VARCHAR) AS file_id, layer * 128 + dim AS p, round(m, 6) AS x FROM s UNION ALL SELECT CAST(label AS VARCHAR), layer * 128 + 64 + dim, round(s, 6) FROM s""")
def layer_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations over the unmasked frames of three layers, side by side."""
    e = S.read(spark, d, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("file_id"), (F.col("vec_id") % 3).alias("layer"), F.col("vec_id").alias("frame"), (F.col("vec_id") % 5 == 0).alias("masked"), F.transform("embedding", lambda x: x.cast("double")).alias("state"))
    out = detectors.layer_statistics(rows).select("file_id", F.posexplode("features").alias("p", "x"))
    return rounded(out.withColumn("p", F.col("p").cast("long")), "x")


@query("""WITH s AS (SELECT label, dim, avg(x) AS m, sqrt(var_pop(x) + 1e-8::DOUBLE) AS s FROM (SELECT label, unnest(generate_series(0, 63)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL)
    SELECT CAST(label AS VARCHAR) AS file_id, dim AS p, round(m, 6) AS x FROM s UNION ALL SELECT CAST(label AS VARCHAR), 64 + dim, round(s, 6) FROM s""")
def pooled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation over the frames of each clip."""
    frames = S.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("file_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    out = training.pooled(frames).select("file_id", F.posexplode("embedding").alias("p", "x"))
    return rounded(out.withColumn("p", F.col("p").cast("long")), "x")


# --- filters of 101 taps -----------------------------------------------------


def _fir_sql(taps: list[float]) -> str:
    return " + ".join(f"coalesce(lag(value, {i}) OVER o, 0.0::DOUBLE) * {t!r}::DOUBLE" if i else f"value * {t!r}::DOUBLE" for i, t in enumerate(taps))


_LOW, _BAND = [float(t) for t in dsp.fir_lowpass()], [float(t) for t in dsp.fir_bandpass()]


@query(f"""SELECT user_id, event_id, round({_fir_sql(_LOW)}, 6) AS low, round({_fir_sql(_BAND)}, 6) AS band, round(value - ({_fir_sql(_LOW)}), 6) AS residual
    FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def fir_101_taps(spark: SparkSession, d: str) -> DataFrame:
    """The low-pass and band-pass filters of the residual fingerprints, and what the low-pass takes away."""
    rows = S.read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    order = ["ts", "event_id"]
    out = W.fir(W.fir(rows, "user_id", order, "value", _LOW, "low"), "user_id", order, "value", _BAND, "band")
    return rounded(out.select("user_id", "event_id", "low", "band", (F.col("value") - F.col("low")).alias("residual")), "low", "band", "residual")


# --- spectra of event sequences ----------------------------------------------


def _sequence(spark: SparkSession, d: str, key: str) -> DataFrame:
    """Values of the events with one key as a waveform, in time's order."""
    rows = S.read(spark, d, "events").groupBy(F.col(key).cast("string").alias("file_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select("file_id", F.lit(16_000).alias("sample_rate"), F.transform("s", lambda x: x["value"]).alias("samples"))


def _table(name: str, column: str, values: list[float]) -> str:
    return f"{name}(k, {column}) AS (VALUES {', '.join(f'({i}, {v!r}::DOUBLE)' for i, v in enumerate(values))})"


def _db_sql(signal: str, out: str) -> str:
    """Mean spectrum in dB of (g, i, x): frames of 400 every 160 samples after half a frame of zeros, transforms of 512."""
    return f"""{out}f AS (SELECT s.g, f, i + 200 - 160 * f AS k, x FROM {signal} s JOIN t USING (g) WHERE i + 200 - 160 * f BETWEEN 0 AND 399),
    {out}x AS (SELECT g, f, b, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 400)) * cos(2 * pi() * b * k / 512)) / 200 AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 400)) * sin(2 * pi() * b * k / 512)) / 200 AS im
      FROM {out}f, bins GROUP BY g, f, b),
    {out} AS (SELECT t.g, b, avg(10 * log10(coalesce(re * re + im * im, 0) + 1e-10::DOUBLE)) AS db FROM t CROSS JOIN bins LEFT JOIN {out}x USING (g, f, b) GROUP BY t.g, b)"""


@query(f"""WITH s AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events), {_table("taps", "tap", _LOW)},
    t AS (SELECT g, unnest(generate_series(0, CAST(ceil(n / 160.0) AS BIGINT))) AS f FROM (SELECT g, count(*) AS n FROM s GROUP BY g)), bins AS (SELECT unnest(generate_series(0, 256)) AS b),
    y AS (SELECT s.g, s.i, sum(o.x * tap) AS x FROM s JOIN s AS o ON o.g = s.g AND o.i <= s.i AND o.i > s.i - 101 JOIN taps ON k = s.i - o.i GROUP BY s.g, s.i),
    {_db_sql("s", "a")}, {_db_sql("y", "z")} SELECT CAST(g AS VARCHAR) AS file_id, b AS bin, round(a.db - z.db, 5) AS residual FROM a JOIN z USING (g, b)""")
def spectral_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Each user's mean spectrum less that of its low-passed sequence."""
    out = detectors.residuals(_sequence(spark, d, "user_id")).select("file_id", F.posexplode("vector").alias("bin", "residual"))
    return rounded(out.withColumn("bin", F.col("bin").cast("long")), "residual", digits=5)


def _slope_taps(order: int) -> list[float]:
    """Weights of nine frames in the slope (1) or curvature (2) of their fitted polynomial."""
    return [float(dsp.slopes(row[None, :], order)[0, 0]) for row in np.eye(9)]


@query(f"""WITH e0 AS (SELECT event_type AS g, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, value AS x FROM events),
    s AS (SELECT g, unnest(generate_series(0, CAST(ceil(1600.0 / n) AS BIGINT) - 1)) * n + i AS i, x FROM e0), bins AS (SELECT unnest(generate_series(0, 256)) AS b),
    n AS (SELECT g, count(*) // 160 AS top FROM s GROUP BY g), t AS (SELECT g, top, unnest(generate_series(0, top)) AS f FROM n),
    w AS (SELECT s.g, f, i + 256 - 160 * f AS k, x * (0.5 - 0.5 * cos(2 * pi() * (i + 200 - 160 * f) / 400)) AS x FROM s JOIN t USING (g) WHERE i + 200 - 160 * f BETWEEN 0 AND 399),
    x AS (SELECT g, f, b, sum(x * cos(2 * pi() * b * k / 512)) AS re, sum(x * sin(2 * pi() * b * k / 512)) AS im FROM w, bins GROUP BY g, f, b),
    fb AS (SELECT m, b, greatest(0, least((31.25 * b - 8000.0 * m / 21) / (8000.0 / 21), (8000.0 * (m + 2) / 21 - 31.25 * b) / (8000.0 / 21))) AS share FROM bins, (SELECT unnest(generate_series(0, 19)) AS m)),
    l AS (SELECT g, f, m, ln(sum(share * (re * re + im * im)) + 1e-10::DOUBLE) AS l FROM x JOIN fb USING (b) GROUP BY g, f, m),
    c AS (SELECT g, f, q, sum(l * cos(pi() * q * (2 * m + 1) / 40)) * sqrt(2.0 / 20) / CASE WHEN q = 0 THEN sqrt(2.0) ELSE 1.0 END AS c FROM l, (SELECT unnest(generate_series(0, 19)) AS q) GROUP BY g, f, q),
    {_table("one", "tap", _slope_taps(1))}, {_table("two", "tap", _slope_taps(2))},
    e AS (SELECT t.g, t.f, least(greatest(t.f, 4), top - 4) AS mid FROM t),
    d AS (SELECT g, f, q, c AS v FROM c UNION ALL SELECT e.g, e.f, 20 + q, sum(c * tap) FROM e JOIN c ON c.g = e.g AND c.f BETWEEN mid - 4 AND mid + 4 JOIN one ON k = c.f - mid + 4 GROUP BY e.g, e.f, q
      UNION ALL SELECT e.g, e.f, 40 + q, sum(c * tap) FROM e JOIN c ON c.g = e.g AND c.f BETWEEN mid - 4 AND mid + 4 JOIN two ON k = c.f - mid + 4 GROUP BY e.g, e.f, q)
    SELECT g AS file_id, q AS place, round(avg(v), 5) AS value FROM d GROUP BY g, q UNION ALL SELECT g, 60 + q, round(stddev_pop(v), 5) FROM d GROUP BY g, q""")
def cepstral_statistics(spark: SparkSession, d: str) -> DataFrame:
    """120 linear-frequency cepstral numbers of each event type's sequence, repeated whole up to 1600 samples or more."""
    times = F.ceil(F.lit(1600) / F.size("samples")).cast("int")
    out = detectors.lfcc(_sequence(spark, d, "event_type").withColumn("samples", F.flatten(F.array_repeat("samples", times)))).select("file_id", F.posexplode("lfcc").alias("place", "value"))
    return rounded(out.withColumn("place", F.col("place").cast("long")), "value", digits=5)


# --- fingerprints of two numbers ---------------------------------------------


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), CAST(vec_id AS VARCHAR)) AS k FROM v),
    p AS (SELECT label, avg(x) AS mx, avg(y) AS my, coalesce(covar_samp(x, x), 0) + 1e-6::DOUBLE AS a, coalesce(covar_samp(x, y), 0) AS b, coalesce(covar_samp(y, y), 0) + 1e-6::DOUBLE AS c FROM k WHERE k <= 500 GROUP BY label),
    e AS (SELECT vec_id, p.label < 5 AS is_real, sqrt(greatest(0, (c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * c - b * b))) AS d FROM v, p)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, round(r, 5) AS d_real, round(f, 5) AS d_fake, round(r / (r + f), 5) AS score
    FROM (SELECT vec_id, min(CASE WHEN is_real THEN d END) AS r, min(CASE WHEN NOT is_real THEN d END) AS f FROM e GROUP BY vec_id)""")
def fingerprint_distances(spark: SparkSession, d: str) -> DataFrame:
    """Mean, inverse covariance and Mahalanobis distances on the first two numbers of each vector."""
    rows = S.read(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("file_id"), F.col("label").cast("string").alias("source"), (F.col("label") < 5).alias("is_real"),
        F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("vector"),
    )
    out = fingerprints.score(rows, fingerprints.fit(rows, "source", "is_real", "vector", "file_id"), "vector")
    return rounded(out.select("file_id", "d_real", "d_fake", "score"), "d_real", "d_fake", "score", digits=5)


# --- novelty -----------------------------------------------------------------

#: The combined curve at every frame (zero where no kernel fits), its strict maxima, and how far they stand out.
_PEAKS = f"""{_curve_sql((2, 4))}, m0 AS (SELECT seq, b, max(novelty) AS v, arg_max(scale, novelty) AS scale FROM curve GROUP BY seq, b),
    w AS (SELECT f.seq, f.idx AS b, coalesce(m.v, 0.0) AS v, m.scale, (lag(f.frame_time) OVER (PARTITION BY f.seq ORDER BY f.idx) + f.frame_time) / 2 AS time_sec FROM frames f LEFT JOIN m0 AS m ON m.seq = f.seq AND m.b = f.idx),
    l AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after FROM w WINDOW o AS (PARTITION BY seq ORDER BY b)),
    c AS (SELECT * FROM l WHERE v > before AND v > after AND v >= 0.2::DOUBLE AND scale IS NOT NULL),
    r AS (SELECT c.seq, c.b, coalesce(max(w.b) FILTER (w.b < c.b AND w.v > c.v), -1) AS lo, coalesce(min(w.b) FILTER (w.b > c.b AND w.v > c.v), 1000000) AS hi FROM c JOIN w USING (seq) GROUP BY c.seq, c.b, c.v),
    f0 AS (SELECT r.seq, r.b, greatest(min(w.v) FILTER (w.b > r.lo AND w.b <= r.b), min(w.v) FILTER (w.b >= r.b AND w.b < r.hi)) AS base FROM r JOIN w USING (seq) GROUP BY r.seq, r.b),
    peaks AS (SELECT c.* FROM c JOIN f0 USING (seq, b) WHERE c.v - f0.base >= 0.05::DOUBLE)"""
_PER_FILE = f"""{_PEAKS}, k0 AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY v DESC, b) AS k FROM m0),
    per AS (SELECT seq, max(v) AS novelty_max, avg(CASE WHEN k <= 3 THEN v END) AS novelty_top3_mean, quantile_cont(v, 0.95) AS novelty_p95,
      (SELECT CAST(count(*) AS DOUBLE) FROM peaks WHERE peaks.seq = k0.seq) AS novelty_n_peaks FROM k0 GROUP BY seq)"""


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return S.frames(spark, d).select(F.col("seq").cast("string").alias("file_id"), F.col("idx").alias("frame_idx"), "frame_time", F.col("e").alias("embedding"))


@query(with_views(f"WITH {_PEAKS} SELECT CAST(seq AS VARCHAR) AS file_id, round(time_sec, 6) AS time_sec, round(v, 6) AS score, b AS boundary, scale FROM peaks", "frames"))
def novelty_peaks(spark: SparkSession, d: str) -> DataFrame:
    found = detectors.embedding_novelty(_sequences(spark, d)).select("file_id", F.explode("candidates").alias("c"))
    return found.select("file_id", F.round("c.time_sec", 6).alias("time_sec"), F.round("c.score", 6).alias("score"), F.col("c.boundary").alias("boundary"), F.col("c.scale").alias("scale"))


@query(with_views(f"WITH {_PER_FILE} SELECT CAST(seq AS VARCHAR) AS file_id, round(novelty_max, 6) AS novelty_max, round(novelty_top3_mean, 6) AS novelty_top3_mean, round(novelty_p95, 6) AS novelty_p95, novelty_n_peaks FROM per", "frames"))
def novelty_per_file(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detectors.novelty_table(detectors.embedding_novelty(_sequences(spark, d))), "novelty_max", "novelty_top3_mean", "novelty_p95")


_LONG = " UNION ALL ".join(f"SELECT seq, '{c}' AS feature, {c} AS value FROM per" for c in detectors.NOVELTY_FEATURES)


@query(with_views(f"""WITH {_PER_FILE}, x AS (SELECT CASE WHEN seq % 3 = 0 THEN 'partial' ELSE 'bonafide' END AS label, feature, value FROM ({_LONG}))
    SELECT label, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median,
      round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM x GROUP BY label, feature""", "frames"))
def novelty_distributions(spark: SparkSession, d: str) -> DataFrame:
    frames = _sequences(spark, d)
    labels = frames.select("file_id").distinct().withColumn("label", F.when(F.col("file_id").cast("int") % 3 == 0, "partial").otherwise("bonafide"))
    return rounded(detectors.feature_distributions(frames, labels), "mean", "std", "min", "median", "p95", "max")


# --- explanation -------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'flat ' || doc_id WHEN 1 THEN 'one ' || doc_id || chr(10) || 'two' ELSE 'only ' || lang END AS text FROM documents""")
def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of service replies in their three shapes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for i, lang in zip(pdf["doc_id"], pdf["lang"], strict=True):
                flat = {"output_text": f" flat {i} "}
                parts = {"output": [{"content": [{"text": f"one {i} "}, {"refusal": "x"}, {"text": " "}]}, {"content": [{"text": "two"}]}, "noise"]}
                texts.append(explain.reply_text([flat, parts, {"output_text": " ", "output": [{"content": [{"text": f"only {lang}"}]}]}][i % 3]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return S.read(spark, d, "documents").select("doc_id", "lang").mapInPandas(rows, "doc_id long, text string")


@query(with_views(f"""WITH s AS ({_SUMMARY}), k AS (SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS k FROM window_scores)
    SELECT s.user_id, regexp_extract(j, '"file":"([^"]*)"', 1) AS file, n_windows, n_shown, round(top3_mean, 6) AS score, CASE WHEN top3_mean >= 0.15::DOUBLE THEN 'FAKE' ELSE 'REAL' END AS verdict, first_start
    FROM s JOIN (SELECT user_id, count(*) AS n_shown, min(CASE WHEN k = 1 THEN CAST(event_id AS DOUBLE) END) AS first_start, '"file":"' || user_id || '"' AS j FROM k WHERE k <= 10 GROUP BY user_id) USING (user_id)""", "window_scores"))
def context_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from the explanation records' JSON."""
    records = explain.context(S.window_scores(spark, d).withColumn("start", F.col("event_id").cast("double")), "user_id")
    kind = "file string, metadata string, n_windows long, p90 double, score double, top_windows array<struct<start: double, score: double>>, verdict string"
    read = explain.context_json(records, "user_id").select("user_id", F.from_json("json", kind).alias("r"))
    return read.select(
        "user_id", F.col("r.file").alias("file"), F.col("r.n_windows").alias("n_windows"), F.size("r.top_windows").cast("long").alias("n_shown"), F.col("r.score").alias("score"),
        F.col("r.verdict").alias("verdict"), F.col("r.top_windows")[0]["start"].alias("first_start"),
    )


# --- out-of-fold scores ------------------------------------------------------


@query(with_views("SELECT fold, label, count(*) AS n, count(*) AS finite FROM manifest WHERE label IS NOT NULL GROUP BY ALL", "manifest"))
def oof_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled row has one finite out-of-fold score."""
    rows = S.manifest(spark, d).join(S.read(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("length")), "doc_id").select("file_id", "label", "fold", "length")
    found = learning.cross_validate(rows, "logistic").predictions
    return found.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~validate.not_finite("score")).alias("finite"))
