"""Queries that write their tables as files and read them back, streams over them, and the SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import aggregate as A
from ..runtime import scratch
from ..sources import manifest as M
from ..sources import sinks, tables
from ..streaming import windows as stream
from . import standins as S
from .catalogue import _SUMMARY, _curve_sql, _min_dcf_sql, query, rounded, with_views


def _csv(rows: DataFrame, name: str, sep: str = ",") -> str:
    path = scratch(rows.sparkSession, name)
    rows.coalesce(1).write.csv(path, header=True, sep=sep)
    return path


# --- delimited tables --------------------------------------------------------


@query(with_views("SELECT 'clips/' || file_id || '.wav' AS path, CASE WHEN label = 1 THEN 'spoof' ELSE 'bonafide' END AS label, generator, fold, lang FROM manifest", "manifest"))
def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written and read as a CSV: known columns first, the fold a number."""
    rows = S.manifest(spark, d).select("lang", F.concat(F.lit("clips/"), "file_id", F.lit(".wav")).alias("path"), "fold", "generator", F.when(F.col("label") == 1, "spoof").otherwise("bonafide").alias("label"))
    return tables.read_manifest(spark, _csv(rows, "manifest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(n_chars AS INTEGER) AS length, n_chars / 8.0::DOUBLE AS eighth, lang FROM documents")
def table_file(spark: SparkSession, d: str) -> DataFrame:
    """A CSV with its types inferred; ids stay text."""
    rows = S.read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("length"), (F.col("n_chars") / 8).alias("eighth"), "lang")
    return tables.read_table(spark, _csv(rows, "table"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS said, CAST(n_chars AS VARCHAR) AS score FROM documents")
def text_table_file(spark: SparkSession, d: str) -> DataFrame:
    """A tab-separated table, all text, with the columns that it must have."""
    rows = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("said"), F.col("n_chars").alias("score"))
    return tables.read_text_table(spark, _csv(rows, "text-table", "\t"), ["id", "score"], "tab")


@query(with_views(f"SELECT min_dcf, threshold, p_miss, p_fa, n_bonafide, n_spoof FROM ({_min_dcf_sql('scored')})", "scored"))
def evaluated_files(spark: SparkSession, d: str) -> DataFrame:
    """minDCF of a score file against a label file, both written first."""
    rows = S.scored(spark, d)
    scores = _csv(rows.select(F.col("file_id").alias("id"), "score"), "scores", "\t")
    labels = _csv(rows.select(F.col("file_id").alias("id"), F.when(F.col("is_spoof") == 1, "spoof").otherwise("bonafide").alias("label")), "labels", "\t")
    found = tables.evaluate_files(spark, scores, labels)
    kept = ("min_dcf", "threshold", "p_miss", "p_fa", "n_bonafide", "n_spoof")
    row = spark.createDataFrame([tuple(float(found[c]) for c in kept)], "min_dcf double, threshold double, p_miss double, p_fa double, n_bonafide double, n_spoof double")
    return rounded(row.withColumns({c: F.col(c).cast("long") for c in kept[4:]}), "min_dcf", "p_miss", "p_fa")


# --- sinks -------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The file's lines with their places from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line")).withColumn("place", F.col("place").cast("long"))


_SHARE = "least(1.0::DOUBLE, n_chars / 7000.0::DOUBLE)"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").select(F.concat("lang", F.lit("/"), "doc_id").alias("filename"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(7000.0)).alias("score"), "doc_id")


@query(f"""SELECT 0::BIGINT AS place, 'filename' || chr(9) || 'cm-score' AS line UNION ALL
    SELECT row_number() OVER (ORDER BY doc_id DESC), lang || '/' || doc_id || chr(9) || printf('%.10g', {_SHARE}) FROM documents""")
def score_file(spark: SparkSession, d: str) -> DataFrame:
    """The batch runner's score file, line by line, in the order asked for."""
    path = scratch(spark, "scores") + ".tsv"
    sinks.write_score_tsv(_shares(spark, d), path, [(-F.col("doc_id")).alias("o")])
    return _lines(spark, path)


@query(f"""SELECT 0::BIGINT AS place, 'filename' || chr(9) || 'cm-score' AS line UNION ALL
    SELECT row_number() OVER (ORDER BY lang || '/' || doc_id), lang || '/' || doc_id || chr(9) || printf('%.6f', {_SHARE}) FROM documents""")
def sorted_score_file(spark: SparkSession, d: str) -> DataFrame:
    """Six decimals by name; written twice, so that the second replaces the first."""
    path = scratch(spark, "sorted") + ".tsv"
    sinks.write_tsv(_shares(spark, d).filter("doc_id % 2 = 0"), path)
    sinks.write_tsv(_shares(spark, d), path)
    return _lines(spark, path)


@query(f"SELECT lang || '/' || doc_id AS filename, round({_SHARE}, 6) AS score FROM documents")
def headerless_scores(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "headerless") + ".tsv"
    sinks.write_tsv(_shares(spark, d), path, header=False)
    return rounded(tables.read_headerless_scores(spark, path), "score")


@query(with_views(f"""SELECT CAST(user_id AS VARCHAR) AS file, round(mean, 6) AS mean, max, round(top3_mean, 6) AS top3_mean, round(p90, 6) AS p90, round(high_window_fraction, 6) AS high_window_fraction, n_windows
    FROM ({_SUMMARY})""", "window_scores"))
def summary_file(spark: SparkSession, d: str) -> DataFrame:
    """The summaries as CSV; columns that are no summary stay out."""
    rows = A.window_summary(S.window_scores(spark, d), "user_id").withColumn("extra", F.lit(1)).withColumn("file", F.col("user_id").cast("string"))
    path = scratch(spark, "summaries")
    sinks.write_summaries(rounded(rows, "mean", "top3_mean", "p90", "high_window_fraction"), path)
    kind = "file string, mean double, max double, top3_mean double, p90 double, high_window_fraction double, n_windows long"
    return spark.read.schema(kind).csv(path, header=True)


@query(with_views("SELECT file_id, length(generator) AS x, 2::BIGINT AS makes FROM manifest", "manifest"))
def cached_features(spark: SparkSession, d: str) -> DataFrame:
    """Features made once for the same inputs and settings, and again for other settings."""
    made = []

    def make(rows: DataFrame) -> DataFrame:
        made.append(1)
        return rows.select("file_id", F.length("generator").alias("x"))

    cache, rows = sinks.FeatureCache(spark, scratch(spark, "features")), S.manifest(spark, d)
    cache.get("length", {"v": 1}, rows, "file_id", make)
    out = cache.get("length", {"v": 1}, rows, "file_id", make)
    cache.get("length", {"v": 2}, rows, "file_id", make)
    return out.withColumn("makes", F.lit(len(made)).cast("long"))


# --- the catalogue of recordings ---------------------------------------------

_RELATIVE = "source || '/' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '/' END || 'clip_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.WAV' ELSE '.flac' END"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    relative = F.concat("source", F.lit("/"), F.when(i % 3 == 0, "").otherwise(F.concat("lang", F.lit("/"))), F.lit("clip_"), i, F.when(i % 2 == 0, ".WAV").otherwise(".flac"))
    return S.read(spark, d, "documents").select("doc_id", relative.alias("relative")).withColumn("path", F.concat(F.lit("/data/"), "relative"))


@query(f"""WITH g AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents))
    SELECT '/data/' || {_RELATIVE} AS path, 'spoof' AS label, source AS generator, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS speaker, CAST(doc_id AS VARCHAR) AS sentence_id, '' AS accent_style,
      CASE WHEN doc_id % 2 = 0 THEN 'wav' ELSE 'flac' END AS source_format, source || '_' || CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END || '_' || doc_id AS group_id, fold FROM documents JOIN g USING (source)""")
def synthetic_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Rows of recordings laid out as generator/[speaker/]file."""
    generators = [r["source"] for r in S.read(spark, d, "documents").select("source").distinct().orderBy("source").collect()]  # one row per generator
    return M.synthetic_rows(_listing(spark, d).drop("doc_id"), generators)


@query("""WITH r AS (SELECT '/real/' || lang || '-' || doc_id || '.wav' AS path, lang, doc_id FROM documents WHERE source IS NOT NULL)
    SELECT path, 'bonafide' AS label, 'real' AS generator, 'corpus_' || lang AS speaker, lang || '-' || doc_id AS sentence_id, '' AS accent_style, 'wav' AS source_format, 'corpus_' || lang || '-' || doc_id AS group_id,
      CAST((row_number() OVER (ORDER BY md5('42:' || path), path) - 1) % 10 AS INTEGER) AS fold FROM r""")
def real_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a real corpus, speakers from the names, folds by a seeded shuffle."""
    name = F.concat("lang", F.lit("-"), "doc_id", F.lit(".wav"))
    files = S.read(spark, d, "documents").filter("source IS NOT NULL").select(F.concat(F.lit("/real/"), name).alias("path"), name.alias("relative"))
    real = M.real_rows(files, "corpus", M.leading_speaker)
    return M.build(real.limit(0), [real])


# --- SQL functions -----------------------------------------------------------


@query(with_views(f"SELECT user_id, round(top3_mean, 6) AS top3_mean FROM ({_SUMMARY})", "window_scores"))
def sql_top3_mean(spark: SparkSession, d: str) -> DataFrame:
    udfs.register(spark)
    return rounded(spark.sql("SELECT user_id, top3_mean(score) AS top3_mean FROM {scores} GROUP BY user_id", scores=S.window_scores(spark, d)), "top3_mean")


@query("""SELECT doc_id, CAST(unnest(generate_series(0, len(starts) - 1)) AS INTEGER) AS window_idx, CAST(unnest(starts) AS BIGINT) AS start_sample FROM (
    SELECT doc_id, CASE WHEN n <= 400 THEN [0::BIGINT] ELSE list_distinct(list_concat(generate_series(0::BIGINT, n - 400, 40), [n - 400])) END AS s, list_sort(s) AS starts FROM (SELECT doc_id, n_chars AS n FROM documents))""")
def sql_explode_windows(spark: SparkSession, d: str) -> DataFrame:
    udfs.register(spark)
    docs = S.read(spark, d, "documents").select("doc_id", "n_chars")
    return spark.sql("SELECT doc_id, w.window_idx, w.start_sample FROM {docs}, LATERAL explode_windows(CAST(n_chars AS INT), 400, 40) AS w", docs=docs)


# --- streams -----------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, two to a batch."""
    folder = scratch(spark, "landing")
    rows = S.read(spark, d, "events")
    rows.repartition(4, "event_id").write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def _drained(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """What a stream has written when its input is used up, with the number of its batch."""
    path = scratch(spark, "streamed")
    sink = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    running = out.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "progress")).foreachBatch(sink).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(path)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream; a window's last update is its count."""
    counts = stream.tumbling(stream.event_time(_stream(spark, d), "ts", "3650 days"), "1 hour", "event_type")
    updates = _drained(spark, counts, "update")
    last = updates.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.col("window.start").alias("start"), "event_type", "n")


@query(with_views(f"SELECT user_id, round(top3_mean, 6) AS top3_mean, n_windows AS n FROM ({_SUMMARY})", "window_scores"))
def streamed_top3_mean(spark: SparkSession, d: str) -> DataFrame:
    """The running mean of each file's three best windows, after the last batch that brought it any."""
    scores = _stream(spark, d).select("user_id", F.least(F.lit(1.0), F.col("value") / F.lit(500.0)).alias("score"))
    updates = _drained(spark, stream.running_top3(scores, "user_id"), "update")
    return rounded(updates.groupBy("user_id").agg(F.max_by("top3_mean", "batch").alias("top3_mean"), F.max("n").alias("n")), "top3_mean")


@query(with_views("""SELECT CAST(seq AS VARCHAR) AS file_id, idx AS frame_idx, round(1 - list_cosine_similarity(lag(e) OVER o, e), 6) AS change FROM frames WINDOW o AS (PARTITION BY seq ORDER BY idx) QUALIFY idx > 0""", "frames"))
def streamed_changes(spark: SparkSession, d: str) -> DataFrame:
    """How far each frame of a stream is from the one before, frames arriving in four batches."""
    frames = S.frames(spark, d).select(F.col("seq").cast("string").alias("file_id"), F.col("idx").alias("frame_idx"), F.col("e").alias("embedding"))
    folder = scratch(spark, "frames")
    for part in range(4):  # one file a batch, in order
        frames.filter(F.floor(F.col("frame_idx") / 13) == part).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return rounded(_drained(spark, stream.running_change(arriving), "append").drop("batch"), "change")


@query(with_views(f"""WITH {_curve_sql((2, 4))} SELECT CAST(f.seq AS VARCHAR) AS file_id, f.idx AS b, round(coalesce(max(novelty), 0.0), 6) AS novelty FROM frames f LEFT JOIN curve c ON c.seq = f.seq AND c.b = f.idx GROUP BY f.seq, f.idx""", "frames"))
def sql_novelty(spark: SparkSession, d: str) -> DataFrame:
    udfs.register(spark)
    rows = S.frames(spark, d).groupBy(F.col("seq").cast("string").alias("file_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "e"))), lambda x: x["e"]).alias("frames"))
    return rounded(spark.sql("SELECT file_id, posexplode(novelty(frames)) AS (b, novelty) FROM {rows}", rows=rows), "novelty")
