"""Every query of the library by name, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import joins, metrics, novelty, sampling, validate
from ..operators import windows as W
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def with_views(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({S.SQL[n]})" for n in names) + (", " + body.removeprefix("WITH ") if body.startswith("WITH ") else " " + body)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- detection metrics -------------------------------------------------------


def _min_dcf_sql(rows: str, group: str = "") -> str:
    g, on = (f"{group}, ", f"USING ({group})") if group else ("", "ON true")
    by = f"PARTITION BY {group} " if group else ""
    grouped = f"GROUP BY {group}" if group else ""
    return f"""WITH c AS (SELECT {g}score AS s, sum(1 - is_spoof) AS nb, sum(is_spoof) AS ns FROM {rows} GROUP BY {g}score),
      r AS (SELECT {g}s, sum(nb) OVER ({by}ORDER BY s DESC) AS cb, sum(ns) OVER ({by}ORDER BY s DESC) AS cs FROM c),
      t AS (SELECT {g}CAST(sum(nb) AS DOUBLE) AS tb, CAST(sum(ns) AS DOUBLE) AS ts, max(s) AS top FROM c {grouped}),
      p AS (SELECT {g}s AS threshold, CAST(cb AS DOUBLE) / tb AS p_miss, (ts - CAST(cs AS DOUBLE)) / ts AS p_fa, -s AS pos, tb, ts FROM r JOIN t {on} WHERE tb > 0 AND ts > 0
            UNION ALL SELECT {g}top + 0.001::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, -top - 0.001::DOUBLE, tb, ts FROM t WHERE tb > 0 AND ts > 0),
      k AS (SELECT *, 1.0::DOUBLE * p_miss * 0.7::DOUBLE + 4.0::DOUBLE * p_fa * (1.0::DOUBLE - 0.7::DOUBLE) AS cost FROM p),
      b AS (SELECT *, row_number() OVER ({by}ORDER BY cost, pos) AS rn FROM k)
      SELECT {g}round(cost / least(1.0::DOUBLE * 0.7::DOUBLE, 4.0::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE)), 6) AS min_dcf, threshold, round(p_miss, 6) AS p_miss, round(p_fa, 6) AS p_fa,
             CAST(tb AS BIGINT) AS n_bonafide, CAST(ts AS BIGINT) AS n_spoof FROM b WHERE rn = 1"""


def _dcf(df: DataFrame) -> DataFrame:
    return rounded(df, "min_dcf", "p_miss", "p_fa").drop("unnormalized_cost")


@query(with_views(_min_dcf_sql("scored"), "scored"))
def min_dcf_overall(spark: SparkSession, d: str) -> DataFrame:
    return _dcf(metrics.min_dcf(S.scored(spark, d), "score", "is_spoof"))


@query(with_views(_min_dcf_sql("scored", "lang"), "scored"))
def min_dcf_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _dcf(metrics.min_dcf(S.scored(spark, d), "score", "is_spoof", ["lang"]))


_LINES = "(SELECT l_extendedprice AS score, CAST(l_returnflag = 'R' AS INTEGER) AS is_spoof FROM lineitem)"


@query(_min_dcf_sql(_LINES))
def min_dcf_large(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("is_spoof"))
    return _dcf(metrics.min_dcf(rows, "score", "is_spoof"))


@query(with_views("""SELECT i AS point, round(p_miss, 9) AS p_miss, round(p_fa, 9) AS p_fa, threshold FROM (
    SELECT row_number() OVER w AS i, CAST(sum(1 - is_spoof) OVER w AS DOUBLE) / (SELECT sum(1 - is_spoof) FROM scored) AS p_miss,
           CAST((SELECT sum(is_spoof) FROM scored) - sum(is_spoof) OVER w AS DOUBLE) / (SELECT sum(is_spoof) FROM scored) AS p_fa, -score AS threshold
    FROM scored WINDOW w AS (ORDER BY -score, is_spoof, file_id ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT 0, 0.0, 1.0, -max(score) - 0.001::DOUBLE FROM scored)""", "scored"))
def det_curve_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.det_curve(S.scored(spark, d), "score", "is_spoof"), "p_miss", "p_fa", digits=9)


_EER = """WITH c AS (SELECT score AS s, sum(1 - is_spoof) AS nb, sum(is_spoof) AS ns FROM scored GROUP BY score),
    r AS (SELECT s, CAST(coalesce(sum(ns) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(ns) OVER () AS fnr,
                 CAST(sum(nb) OVER () - coalesce(sum(nb) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(nb) OVER () AS fpr FROM c),
    d AS (SELECT *, (1.0::DOUBLE * 0.3::DOUBLE * fnr + 4.0::DOUBLE * 0.7::DOUBLE * fpr) / 0.3::DOUBLE AS dcf FROM r)
    SELECT round((SELECT (fnr + fpr) / 2 FROM d ORDER BY abs(fnr - fpr), s LIMIT 1), 6) AS eer, round((SELECT min(dcf) FROM d), 6) AS min_dcf,
           (SELECT s FROM d ORDER BY dcf, s LIMIT 1) AS threshold"""


@query(with_views(_EER, "scored"))
def eer_alt_dcf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.eer_and_dcf(S.scored(spark, d), "score", "is_spoof"), "eer", "min_dcf")


@query(with_views("""WITH r AS (SELECT is_spoof, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mean_rank FROM scored),
    n AS (SELECT CAST(sum(is_spoof) AS DOUBLE) AS n1, CAST(sum(1 - is_spoof) AS DOUBLE) AS n0 FROM scored)
    SELECT round((sum(CASE WHEN is_spoof = 1 THEN mean_rank ELSE 0 END) - any_value(n1) * (any_value(n1) + 1) / 2) / (any_value(n1) * any_value(n0)), 6) AS auc FROM r, n""", "scored"))
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(S.scored(spark, d), "score", "is_spoof"), "auc")


@query(with_views("""WITH p AS (SELECT is_spoof, least(1.0::DOUBLE, score / 5000.0::DOUBLE) >= 0.5::DOUBLE AS hit FROM scored),
    c AS (SELECT count(*) FILTER (is_spoof = 1 AND hit) AS tp, count(*) FILTER (is_spoof = 0 AND hit) AS fp,
                 count(*) FILTER (is_spoof = 0 AND NOT hit) AS tn, count(*) FILTER (is_spoof = 1 AND NOT hit) AS fn FROM p)
    SELECT tp, fp, tn, fn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 6) AS accuracy, round(CAST(fp AS DOUBLE) / (fp + tn), 6) AS fpr,
           round(CAST(fn AS DOUBLE) / (fn + tp), 6) AS fnr FROM c""", "scored"))
def confusion_at_half(spark: SparkSession, d: str) -> DataFrame:
    rows = S.scored(spark, d).withColumn("p", F.least(F.lit(1.0), F.col("score") / F.lit(5000.0)))
    return rounded(metrics.confusion(rows, "p", "is_spoof"), "accuracy", "fpr", "fnr")


@query(with_views("""SELECT min(score) AS min, max(score) AS max, quantile_cont(score, 0.5) AS median, round(avg(score), 6) AS mean,
    count(*) FILTER (score > 1000) AS above, count(*) FILTER (score < 1000) AS below FROM scored""", "scored"))
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.score_stats(S.scored(spark, d), middle=1000.0), "mean")


# --- windows -----------------------------------------------------------------

_STARTS = """SELECT doc_id, n, CASE WHEN n <= 400 THEN [0::BIGINT]
    ELSE list_distinct(list_concat(generate_series(0::BIGINT, n - 400, 40), [n - 400])) END AS starts FROM (SELECT doc_id, n_chars AS n FROM documents)"""


@query(f"SELECT doc_id, CAST(unnest(starts) AS BIGINT) AS start_sample FROM ({_STARTS})")
def window_starts(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n_samples"))
    return W.windows(docs, window=400, hop=40).select("doc_id", "start_sample")


@query(f"""SELECT doc_id, len(starts) AS n_windows, CAST(list_max(starts) + least(400, n) AS BIGINT) AS covered,
    list_max(starts) / 16000.0::DOUBLE AS last_start, least(list_max(starts) + 400, n) / 16000.0::DOUBLE AS last_end FROM ({_STARTS})""")
def window_cover(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n_samples"))
    w = W.windows(docs, window=400, hop=40)
    return w.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max(F.col("start_sample") + F.least(F.lit(400), F.col("n_samples"))).alias("covered"),
        F.max("start").alias("last_start"), F.max("end").alias("last_end"),
    )


_SUMMARY = """SELECT user_id, avg(score) AS mean, max(score) AS max, avg(CASE WHEN r <= 3 THEN score END) AS top3_mean,
    quantile_cont(score, 0.9) AS p90, avg(CASE WHEN score >= 0.15::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS high_window_fraction, count(*) AS n_windows
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS r FROM window_scores) GROUP BY user_id"""


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return A.window_summary(S.window_scores(spark, d), "user_id")


@query(with_views(f"""SELECT user_id, round(mean, 6) AS mean, max, round(top3_mean, 6) AS top3_mean, round(p90, 6) AS p90,
    round(high_window_fraction, 6) AS high_window_fraction, n_windows FROM ({_SUMMARY})""", "window_scores"))
def window_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_summaries(spark, d), "mean", "top3_mean", "p90", "high_window_fraction")


@query(with_views(f"SELECT user_id, round(top3_mean, 6) AS top3_mean FROM ({_SUMMARY})", "window_scores"))
def top3_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.top3_mean(S.window_scores(spark, d), "user_id"), "top3_mean")


@query(with_views(f"SELECT user_id, round(p90, 6) AS p90 FROM ({_SUMMARY})", "window_scores"))
def p90_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_summaries(spark, d).select("user_id", "p90"), "p90")


@query(with_views(f"SELECT user_id, round(high_window_fraction, 6) AS high_window_fraction FROM ({_SUMMARY})", "window_scores"))
def high_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_summaries(spark, d).select("user_id", "high_window_fraction"), "high_window_fraction")


@query(with_views(f"SELECT user_id, CASE WHEN round(top3_mean, 6) >= 0.9::DOUBLE THEN 'FAKE' ELSE 'REAL' END AS verdict FROM ({_SUMMARY})", "window_scores"))
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(_summaries(spark, d), "top3_mean")
    return out.select("user_id", A.verdict(F.col("top3_mean"), 0.9).alias("verdict"))


@query(with_views(f"SELECT CAST(user_id AS VARCHAR) AS filename, round(top3_mean, 6) AS score FROM ({_SUMMARY})", "window_scores"))
def file_scores_batch(spark: SparkSession, d: str) -> DataFrame:
    scores = S.window_scores(spark, d).withColumn("score", validate.asserted_score("score"))
    out = A.window_summary(scores, "user_id").select(F.col("user_id").cast("string").alias("filename"), F.col("top3_mean").alias("score"))
    return rounded(out, "score")


@query(with_views("""SELECT user_id, event_id, score, rank FROM (SELECT user_id, event_id, score,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts, event_id) AS INTEGER) AS rank FROM window_scores) WHERE rank <= 10""", "window_scores"))
def top10_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = S.window_scores(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return A.top_windows(rows, "user_id", "at").select("user_id", "event_id", "score", "rank")


@query(with_views("""SELECT user_id, max(score) AS local_max, min(score) AS local_min, round(max(score) - min(score), 6) AS local_range,
    round(coalesce(max(abs(score - prev)), 0), 6) AS local_max_jump, round(quantile_cont(score, 0.9), 6) AS local_p90
    FROM (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM window_scores) GROUP BY user_id""", "window_scores"))
def local_score_features(spark: SparkSession, d: str) -> DataFrame:
    out = A.local_score_features(S.window_scores(spark, d), "user_id", ["ts", "event_id"])
    return rounded(out, "local_range", "local_max_jump", "local_p90")


# --- grouped statistics ------------------------------------------------------


@query(with_views("""SELECT CASE WHEN is_spoof = 1 THEN 'spoof' ELSE 'bonafide' END AS label, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    min(value) AS min, quantile_cont(value, 0.5) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max
    FROM (SELECT is_spoof, 'length' AS feature, score AS value FROM scored UNION ALL SELECT is_spoof, 'quality', CAST(quality AS DOUBLE) FROM scored) GROUP BY ALL""", "scored"))
def label_distributions(spark: SparkSession, d: str) -> DataFrame:
    rows = S.scored(spark, d).select(
        F.when(F.col("is_spoof") == 1, "spoof").otherwise("bonafide").alias("label"), F.col("score").alias("length"), F.col("quality").cast("double").alias("quality")
    )
    return rounded(A.distributions(rows, "label", ["length", "quality"]), "mean", "std", "p95")


@query("""SELECT label, dim, round(avg(x), 6) AS mean, round(sqrt(var_pop(x) + 1e-8::DOUBLE), 6) AS std
    FROM (SELECT label, unnest(generate_series(0, 63)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, dim""")
def layer_mean_std(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).withColumns({"x": F.col("x").cast("double"), "dim": F.col("dim").cast("long")})
    return rounded(A.masked_mean_std(rows, ["label", "dim"], "x"), "mean", "std")


@query("""SELECT user_id, round(stddev_pop(value), 6) AS std, CASE WHEN round(stddev_pop(value), 6) < 49 THEN 'too_stable' WHEN round(stddev_pop(value), 6) > 52 THEN 'too_erratic' ELSE 'plausible' END AS verdict
    FROM events GROUP BY user_id""")
def variance_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.stability(S.read(spark, d, "events"), "user_id", "value", 49.0, 52.0), "std")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'fold' || fold AS feature, round(avg(g), 6) AS mean_gain, round(sum(g), 6) AS total_gain
    FROM (SELECT doc_id % 5 AS fold, n_chars / 1000.0::DOUBLE AS g FROM documents) GROUP BY fold""")
def gain_importance(spark: SparkSession, d: str) -> DataFrame:
    gains = S.read(spark, d, "documents").select(F.concat(F.lit("fold"), F.col("doc_id") % 5).alias("feature"), (F.col("n_chars") / F.lit(1000.0)).alias("gain"))
    return rounded(A.importance(gains), "mean_gain", "total_gain")


# --- strict joins ------------------------------------------------------------


@query(with_views("""SELECT m.file_id, CAST(m.label AS TINYINT) AS label, m.fold, CAST(d.n_chars AS DOUBLE) AS length, round(e.activity, 6) AS activity, e.n_events
    FROM manifest m JOIN documents d USING (doc_id) JOIN (SELECT m2.file_id, coalesce(sum(v.value), 0) AS activity, count(v.value) AS n_events
      FROM manifest m2 LEFT JOIN events v ON v.user_id = m2.doc_id GROUP BY m2.file_id) e USING (file_id)""", "manifest"))
def strict_feature_join(spark: SparkSession, d: str) -> DataFrame:
    man = S.manifest(spark, d)
    ids = man.select("file_id", "doc_id")
    length = S.read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("length")).join(ids, "doc_id").select("file_id", "length")
    events = S.read(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.sum("value").alias("activity"), F.count("value").alias("n_events"))
    activity = ids.join(events, "doc_id", "left").select("file_id", F.coalesce("activity", F.lit(0.0)).alias("activity"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
    table = joins.build_feature_table(man.select("file_id", "label", "fold"), {"length": length, "events": activity})
    return rounded(table, "activity")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return joins.missing_ids(S.read(spark, d, "documents"), S.read(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def extra_ids(spark: SparkSession, d: str) -> DataFrame:
    """Labelled ids without an English document."""
    return joins.missing_ids(S.read(spark, d, "labels"), S.read(spark, d, "documents").filter("lang = 'en'"), "doc_id")


@query(with_views("SELECT file_id AS id, CASE WHEN is_spoof = 1 THEN 'spoof' ELSE 'bonafide' END AS label, CAST(n_chars AS DOUBLE) AS score FROM scored", "scored"))
def strict_eval_join(spark: SparkSession, d: str) -> DataFrame:
    rows = S.scored(spark, d)
    labels = validate.check_labels(rows.select("file_id", F.when(F.col("is_spoof") == 1, "spoof").otherwise("bonafide").alias("label")), "file_id")
    docs = S.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").cast("string").alias("prediction"))
    return joins.join_predictions(labels, validate.check_scores(docs, "name", "prediction"), allow_extra=True)


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS filename, round(CASE WHEN l.doc_id IS NULL THEN least(1, n_chars / 5000.0::DOUBLE)
    ELSE 0.7::DOUBLE * least(1, n_chars / 5000.0::DOUBLE) + (1.0::DOUBLE - 0.7::DOUBLE) * CAST(l.toxic AS DOUBLE) END, 6) AS score FROM documents d LEFT JOIN labels l USING (doc_id)""")
def score_blend(spark: SparkSession, d: str) -> DataFrame:
    main = S.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), validate.clipped(F.col("n_chars") / F.lit(5000.0)).alias("score"))
    other = S.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("filename"), F.col("toxic").cast("double").alias("score"))
    return rounded(joins.blend(main, other), "score")


@query("SELECT 'doc/' || doc_id AS path, CASE WHEN lang = 'en' OR doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN lang END AS label FROM documents")
def manifest_append(spark: SparkSession, d: str) -> DataFrame:
    """English documents are the old manifest; all documents are offered as new rows."""
    rows = S.read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("label"))
    return joins.append_new(rows.filter("label = 'en'"), rows)


@query(with_views("""SELECT file_id, lang, round(score / 1000, 6) AS a_length, CAST(quality AS DOUBLE) AS b_quality FROM scored""", "scored"))
def stacked_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = S.scored(spark, d)
    parts = {"b_quality": rows.select("file_id", F.col("quality").cast("double").alias("score")), "a_length": rows.select("file_id", F.round(F.col("score") / 1000, 6).alias("score"))}
    return joins.stack_columns(parts).join(rows.select("file_id", "lang"), "file_id")


# --- labels, paths, folds, samples -------------------------------------------

_SPELLED = """SELECT doc_id, CASE toxic WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN ' Spoof' WHEN 1 THEN 'FAKE ' ELSE '1' END
    ELSE CASE doc_id % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'Bona_Fide' WHEN 2 THEN ' 0 ' ELSE 'unclear' END END AS spelled FROM labels"""


@query(f"""SELECT doc_id, spelled, CAST(coalesce(CASE WHEN lower(trim(spelled)) IN ('0', 'bonafide', 'bona_fide', 'real') THEN 0
    WHEN lower(trim(spelled)) IN ('1', 'spoof', 'synthetic', 'fake') THEN 1 END, -1) AS INTEGER) AS label FROM ({_SPELLED})""")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    fake = F.when(i % 3 == 0, " Spoof").when(i % 3 == 1, "FAKE ").otherwise("1")
    real = F.when(i % 4 == 0, "real").when(i % 4 == 1, "Bona_Fide").when(i % 4 == 2, " 0 ").otherwise("unclear")
    rows = S.read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, fake).otherwise(real).alias("spelled"))
    return rows.withColumn("label", F.coalesce(validate.label_code("spelled").cast("int"), F.lit(-1)))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name,
    lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(\.[^.]+)$', 1)) AS suffix FROM pages""")
def path_parse(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.paths import basename, suffix

    bare = F.regexp_replace("url", "[?#].*$", "")
    return S.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), basename(bare).alias("name"), suffix(basename(bare)).alias("suffix"))


@query(r"""SELECT page_id, '/data/' || regexp_replace(replace('C:\corpus\' || regexp_replace(url, '^[a-z]+://', ''), '\', '/'), '^[cC]:/corpus/', '') AS path FROM pages""")
def path_remap(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.paths import remap

    old = F.concat(F.lit("C:\\corpus\\"), F.regexp_replace("url", "^[a-z]+://", ""))
    return S.read(spark, d, "pages").select("page_id", remap(old, "c:/corpus/", "/data").alias("path"))


@query(with_views("SELECT file_id, label, CASE WHEN fold = 2 THEN 'validation' ELSE 'training' END AS part FROM manifest", "manifest"))
def fold_split(spark: SparkSession, d: str) -> DataFrame:
    train, val = sampling.split_by_fold(S.manifest(spark, d), 2)
    return train.withColumn("part", F.lit("training")).unionByName(val.withColumn("part", F.lit("validation"))).select("file_id", "label", "part")


@query(with_views("SELECT fold, label, count(*) AS n FROM manifest GROUP BY ALL", "manifest"))
def fold_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.counts_by(S.manifest(spark, d), "fold", "label")


@query(with_views("SELECT generator, count(*) AS n FROM manifest GROUP BY ALL", "manifest"))
def generator_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.counts_by(S.manifest(spark, d), "generator")


@query(with_views("SELECT fold, min(doc_id) AS first_seen FROM manifest GROUP BY fold", "manifest"))
def folds_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_seen(S.manifest(spark, d), "fold", "doc_id")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) % 10 AS INTEGER) AS fold FROM documents")
def fold_assign_hash(spark: SparkSession, d: str) -> DataFrame:
    return sampling.assign_folds(S.read(spark, d, "documents").select("doc_id"), "doc_id")


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
    r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)
    SELECT doc_id, source FROM r JOIN g USING (source) WHERE k <= 150 // n + CASE WHEN i < 150 % n THEN 1 ELSE 0 END""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "documents").select("doc_id", "source")
    return sampling.capped_per_group(rows, "source", "doc_id", 150).select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_rows(S.read(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("""SELECT source FROM (SELECT DISTINCT source FROM documents WHERE lang = 'es') INTERSECT SELECT source FROM (SELECT DISTINCT source FROM documents WHERE lang = 'de')""")
def shared_generators(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents")
    return docs.filter("lang = 'es'").select("source").intersect(docs.filter("lang = 'de'").select("source"))


@query("SELECT DISTINCT n_chars AS threshold FROM documents")
def distinct_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").select(F.col("n_chars").alias("threshold")).distinct()


# --- embeddings --------------------------------------------------------------

_SIM = "list_cosine_similarity(a.e, b.e)"


@query(with_views(f"SELECT a.seq, a.idx AS i, b.idx AS j, round({_SIM}, 6) AS sim FROM frames a JOIN frames b ON a.seq = b.seq AND b.idx BETWEEN a.idx AND a.idx + 1", "frames"))
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(novelty.band_pairs(S.frames(spark, d), "seq", "idx", "e", 2), "sim")


@query(with_views(f"SELECT a.seq, a.idx AS i, b.idx AS j, round({_SIM}, 6) AS sim FROM frames a JOIN frames b ON a.seq = b.seq AND b.idx BETWEEN a.idx AND a.idx + 7", "frames"))
def self_similarity_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(novelty.band_pairs(S.frames(spark, d), "seq", "idx", "e", 8), "sim")


def _curve_sql(scales: tuple[int, ...]) -> str:
    cells = ", ".join(f"({s}, {i}, {j}, {v!r}::DOUBLE)" for s in scales for i, j, v in novelty.kernel(s))
    return f"""k(scale, ki, kj, weight) AS (VALUES {cells}), n AS (SELECT seq, count(*) AS n FROM frames GROUP BY seq),
      s AS (SELECT a.seq, a.idx AS i, b.idx AS j, {_SIM} AS sim FROM frames a JOIN frames b ON a.seq = b.seq AND abs(a.idx - b.idx) < {2 * max(scales)}),
      v AS (SELECT s.seq, k.scale, s.i - k.ki + k.scale AS b, greatest(0, sum(s.sim * k.weight)) AS novelty FROM s JOIN k ON s.j - s.i = k.kj - k.ki GROUP BY ALL),
      curve AS (SELECT seq, CAST(scale AS INTEGER) AS scale, CAST(b AS INTEGER) AS b, novelty FROM v JOIN n USING (seq) WHERE b >= scale AND b <= n - scale)"""


@query(with_views(f"WITH {_curve_sql((2, 4))} SELECT seq, scale, b, round(novelty, 6) AS novelty FROM curve", "frames"))
def novelty_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(novelty.curves(S.frames(spark, d), "seq", "idx", "e"), "novelty")


@query(with_views(f"""WITH {_curve_sql((2, 4))}, m AS (SELECT seq, b, round(max(novelty), 9) AS novelty FROM curve GROUP BY seq, b),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY novelty DESC, b) AS k FROM m)
    SELECT seq, round(max(novelty), 6) AS novelty_max, round(avg(CASE WHEN k <= 3 THEN novelty END), 6) AS novelty_top3_mean,
           round(quantile_cont(novelty, 0.95), 6) AS novelty_p95, min(CASE WHEN k = 1 THEN b END) AS strongest FROM r GROUP BY seq""", "frames"))
def novelty_features(spark: SparkSession, d: str) -> DataFrame:
    best = rounded(novelty.combined(novelty.curves(S.frames(spark, d), "seq", "idx", "e"), "seq"), "novelty", digits=9)
    return rounded(novelty.summary(best, "seq"), "novelty_max", "novelty_top3_mean", "novelty_p95")


@query(with_views("""SELECT seq, idx, round(coalesce((lag(frame_time) OVER (PARTITION BY seq ORDER BY idx) + frame_time) / 2, frame_time), 6) AS boundary_time FROM frames""", "frames"))
def boundary_times(spark: SparkSession, d: str) -> DataFrame:
    out = W.boundary_times(S.frames(spark, d), "seq", "idx", "frame_time").select("seq", "idx", "boundary_time")
    return rounded(out, "boundary_time")


# --- signals in rows ---------------------------------------------------------


@query("""WITH w AS (SELECT user_id, event_id, value, abs(value - lag(value) OVER o) AS jump, stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS local_std
      FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(jump, 6) AS jump FROM w WHERE jump > 0.05::DOUBLE AND (jump > 3.0::DOUBLE * local_std OR local_std = 0)""")
def jump_flags(spark: SparkSession, d: str) -> DataFrame:
    out = W.jump_flags(S.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return rounded(out.filter("flag").select("user_id", "event_id", "jump"), "jump")


@query("""WITH w AS (SELECT user_id, event_id, value AS b, lag(value) OVER o AS a, lead(value) OVER o AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(CASE WHEN a IS NULL OR c IS NULL OR a - 2 * b + c = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * (a - c) / (a - 2 * b + c) END, 6) AS delta
    FROM w WHERE b >= coalesce(a, b) AND b >= coalesce(c, b)""")
def parabolic_peaks(spark: SparkSession, d: str) -> DataFrame:
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    rows = S.read(spark, d, "events").select("user_id", "event_id", v.alias("b"), F.lag(v).over(o).alias("a"), F.lead(v).over(o).alias("c"))
    peaks = rows.filter((F.col("b") >= F.coalesce("a", "b")) & (F.col("b") >= F.coalesce("c", "b")))
    return rounded(peaks.select("user_id", "event_id", W.parabolic_offset(F.col("a"), F.col("b"), F.col("c")).alias("delta")), "delta")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS moving_max FROM events")
def moving_max(spark: SparkSession, d: str) -> DataFrame:
    return W.moving_extreme(S.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 4).select("user_id", "event_id", "moving_max")


@query("SELECT user_id, event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS moving_median FROM events")
def moving_median(spark: SparkSession, d: str) -> DataFrame:
    out = W.moving_median(S.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 4).select("user_id", "event_id", "moving_median")
    return rounded(out, "moving_median")


@query("SELECT user_id, event_id, round(avg(value * value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS energy FROM events")
def window_energy(spark: SparkSession, d: str) -> DataFrame:
    out = W.window_energy(S.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 7).select("user_id", "event_id", "energy")
    return rounded(out, "energy")


@query("""SELECT user_id, event_id, round(abs(value - lead(value, 1, first) OVER o) / 2, 6) AS detail FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events)
    WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def haar_detail(spark: SparkSession, d: str) -> DataFrame:
    """Undecimated Haar detail, periodic at the end of the sequence."""
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = S.read(spark, d, "events")
    after = F.coalesce(F.lead("value").over(o), F.first("value").over(o))
    return rounded(rows.select("user_id", "event_id", (F.abs(F.col("value") - after) / 2).alias("detail")), "detail")


def _taps() -> list[float]:
    from ..functions.dsp import fir_lowpass as design

    return [float(x) for x in design(9, 1000.0, 16_000.0)]


@query(
    "SELECT user_id, event_id, round("
    + " + ".join(f"coalesce(lag(value, {i}) OVER o, 0.0::DOUBLE) * {t!r}::DOUBLE" if i else f"value * {t!r}::DOUBLE" for i, t in enumerate(_taps()))
    + ", 6) AS filtered FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def fir_lowpass(spark: SparkSession, d: str) -> DataFrame:
    out = W.fir(S.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", _taps()).select("user_id", "event_id", "filtered")
    return rounded(out, "filtered")


@query("""SELECT user_id, round(sum(hz * e) / (sum(e) + 1e-12::DOUBLE), 6) AS centroid
    FROM (SELECT user_id, (floor(value / 50) + 0.5::DOUBLE) * 62.5::DOUBLE AS hz, value * value AS e FROM events) GROUP BY user_id""")
def spectral_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "events").select("user_id", ((F.floor(F.col("value") / 50) + F.lit(0.5)) * F.lit(62.5)).alias("hz"), (F.col("value") * F.col("value")).alias("e"))
    return rounded(A.centroid(rows, ["user_id"], "hz", "e"), "centroid")


@query("""WITH c AS (SELECT event_id, [greatest(0, value / 100) / 1.15::DOUBLE, greatest(0, value / 10) / 7.0::DOUBLE, greatest(0, value / 7 - 3.0::DOUBLE) / 5.0::DOUBLE, greatest(0, value - 60) / 90.0::DOUBLE] AS ch FROM events)
    SELECT event_id, round(list_max(ch), 6) AS score, ['timbre', 'level', 'transient', 'frequency'][list_position(ch, list_max(ch))] AS kind FROM c""")
def channel_score(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.splice import KINDS, scaled_channels

    v = F.col("value")
    ch = scaled_channels(v / 100, v / 10, v / 7, v - 60)
    rows = S.read(spark, d, "events").select("event_id", F.array(*ch).alias("ch")).withColumn("score", F.array_max("ch"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.array_position("ch", F.col("score")).cast("int"))
    return rounded(rows.select("event_id", "score", kind.alias("kind")), "score")


# --- fingerprints ------------------------------------------------------------


@query("""WITH few AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), CAST(vec_id AS VARCHAR)) AS k FROM embeddings)
    SELECT CAST(label AS VARCHAR) AS source, dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(generate_series(0, 63)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM few WHERE k <= 500) GROUP BY ALL""")
def residual_fit(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fingerprints import fit

    prints = fit(_vectors(spark, d), "source", "is_real", "vector", "file_id")
    out = prints.select("source", F.posexplode("mean").alias("dim", "mean")).withColumn("dim", F.col("dim").cast("long"))
    return rounded(out, "mean")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("file_id"), F.col("label").cast("string").alias("source"), (F.col("label") < 5).alias("is_real"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


@query()
def residual_score(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fingerprints import fit, score

    rows = _vectors(spark, d)
    return rounded(score(rows, fit(rows, "source", "is_real", "vector", "file_id"), "vector").select("file_id", "d_real", "d_fake", "score"), "d_real", "d_fake", "score", digits=4)


# --- explanation -------------------------------------------------------------


@query(with_views(f"""SELECT t.user_id, round(t.top3_mean, 6) AS score, CASE WHEN round(t.top3_mean, 6) >= 0.15::DOUBLE THEN 'FAKE' ELSE 'REAL' END AS verdict, least(t.n_windows, 10) AS n_shown
    FROM ({_SUMMARY}) t""", "window_scores"))
def context_fields(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.explain import context

    out = context(S.window_scores(spark, d).withColumn("start", F.col("event_id").cast("double")), "user_id")
    return rounded(out, "score").select("user_id", "score", A.verdict(F.col("score")).alias("verdict"), F.size("top_windows").cast("long").alias("n_shown"))


@query()
def context_json(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.explain import context, context_json as as_json

    return as_json(context(S.window_scores(spark, d).withColumn("start", F.col("event_id").cast("double")), "user_id"), "user_id")


# --- event time --------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "events")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts) + INTERVAL 30 MINUTE * (CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END),
    date_trunc('hour', ts) + INTERVAL 30 MINUTE * (CASE WHEN minute(ts) >= 30 THEN 0 ELSE -1 END)]) AS start FROM events) GROUP BY start""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "events")
    return rows.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "events")
    return rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
