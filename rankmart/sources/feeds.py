"""Readers for landed feed files (S1-S12): explicit schemas, never inferred.

A separate downloader lands the files (CSV, JSON, HTML) in a folder; these
readers turn them into DataFrames with the shapes the marts expect. Every
reader is a plain Spark scan, so a folder of many snapshots is read in
parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmart import fixed
from rankmart.functions.numeric import nan_to_null
from rankmart.sources.manifest import list_files, newest_paths, read_manifest

BENCH_SCORES = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("model_group", T.StringType()),
    T.StructField("benchmark", T.StringType()),
    T.StructField("performance", T.DoubleType()),
    T.StructField("date", T.StringType()),
])

NOTABLE_MODELS = T.StructType([
    T.StructField("Model", T.StringType()),
    T.StructField("Organization", T.StringType()),
    T.StructField("Publication date", T.StringType()),
    T.StructField("Training compute (FLOP)", T.StringType()),
    T.StructField("Parameters", T.StringType()),
])

GPU_CLUSTERS = T.StructType([
    T.StructField("Name", T.StringType()),
    T.StructField("Owner", T.StringType()),
    T.StructField("Country", T.StringType()),
    T.StructField("Status", T.StringType()),
    T.StructField("Chip type (primary)", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("H100 equivalents", T.StringType()),
    T.StructField("Power Capacity (MW)", T.StringType()),
])

ML_HARDWARE = T.StructType([T.StructField("Manufacturer", T.StringType())])

CATALOG_MODEL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("context_length", T.LongType()),
    T.StructField("pricing", T.StructType([
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
    ])),
    T.StructField("architecture", T.StructType([
        T.StructField("input_modalities", T.ArrayType(T.StringType())),
        T.StructField("output_modalities", T.ArrayType(T.StringType())),
    ])),
])

HUB_MODEL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("downloads", T.LongType()),
    T.StructField("likes", T.LongType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("pipeline_tag", T.StringType()),
    T.StructField("library_name", T.StringType()),
    T.StructField("trendingScore", T.DoubleType()),
])

LEADERBOARD_RESULT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("resolved", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("os_model", T.BooleanType()),
    T.StructField("os_system", T.BooleanType()),
])
LEADERBOARD_DATA = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("results", T.ArrayType(LEADERBOARD_RESULT)),
]))

PACKAGE_RECENT = T.StructType([
    T.StructField("package", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("last_day", T.LongType()),
        T.StructField("last_week", T.LongType()),
        T.StructField("last_month", T.LongType()),
    ])),
])


SRC_ORDER = "struct<part int, file string, block bigint, row bigint>"


FILE_COLUMNS = ("src_file", "src_snapshot", "fetched_at", "src_order", "src_pos")


def _snapshot():
    """Which landing a file belongs to: its ``snapshot=<stamp>`` folder, else the write job named in a part file's
    name (all part files of one write share it), else the file itself."""
    folder = F.regexp_extract("_metadata.file_path", r"/snapshot=([^/]+)/", 1)
    job = F.regexp_extract("_metadata.file_name", r"^part-\d+-([0-9a-f-]{36})", 1)
    one = lambda x: F.when(x != "", x)
    return F.struct(F.coalesce(one(folder), F.lit("")).alias("stamp"),
                    F.coalesce(one(folder), one(job), F.col("_metadata.file_name")).alias("id")).alias("src_snapshot")


def _fetched_at():
    return F.col("_metadata.file_modification_time").cast("timestamp_ntz")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, with_order: bool = False,
             with_file: bool = False) -> DataFrame:
    """CSV with header and an explicit schema.

    Text "NaN" becomes NaN and then null; blank and unparsable numbers are
    null (PERMISSIVE), so aggregates skip them as pandas does (N1, N3).

    ``with_file`` adds ``src_file`` and ``fetched_at`` (the file's landing time).
    ``with_order`` adds ``src_order``, the rows' order in the landed files:
    (file name, start of the file split, row id). Splits of one file are read
    in order and the row id grows within a task, so sorting on it gives file
    order for any number of files and splits (N8: "first seen").
    """
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("nanValue", "NaN").option("enforceSchema", False).csv(path))
    dbl = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    cols = [nan_to_null(F.col(f"`{c}`")).alias(c) if c in dbl else F.col(f"`{c}`") for c in schema.names]
    if with_file:
        cols += [F.col("_metadata.file_name").alias("src_file"), _snapshot(), _fetched_at().alias("fetched_at")]
    if with_order:
        cols.append(F.struct(F.lit(0).alias("part"), F.col("_metadata.file_name").alias("file"),
                             F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("row")).alias("src_order"))
    return df.select(*cols)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON object with the models under ``data`` (S5), one row per model plus its
    position in the file (``src_pos``, the "first seen" order) and file name."""
    wrapper = T.StructType([T.StructField("data", T.ArrayType(CATALOG_MODEL))])
    raw = spark.read.schema(wrapper).option("multiLine", True).json(path) \
        .select("data", F.col("_metadata.file_name").alias("src_file"), _snapshot(), _fetched_at().alias("fetched_at"))
    return (raw.select("src_file", "src_snapshot", "fetched_at", F.posexplode("data").alias("src_pos", "m"))
               .select("src_file", "src_snapshot", "fetched_at", "src_pos", "m.*"))


def read_hub_models(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of hub models (S6, S7) with their position in the response."""
    wrapper = T.ArrayType(HUB_MODEL)
    txt = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("src_file"),
                                                       _snapshot(), _fetched_at().alias("fetched_at"))
    return (txt.select("src_file", "src_snapshot", "fetched_at", F.posexplode(F.from_json("value", wrapper)).alias("src_pos", "m"))
               .select("src_file", "src_snapshot", "fetched_at", "src_pos", "m.*"))


def hub_top(df: DataFrame, order_col: str, n: int, pipeline_tag: str | None = fixed.HUB_PIPELINE_TAG) -> DataFrame:
    """The remote "sort, limit, filter" of the hub API on landed rows."""
    from rankmart.operators.dedup import top_n

    if pipeline_tag is not None:
        df = df.filter(F.col("pipeline_tag") == pipeline_tag)
    return top_n(df, [F.col(order_col).desc(), F.col("id").asc()], n, rank_col="rank")


def modality_champions_from_hub(spark: SparkSession, hub: DataFrame, tags=fixed.HF_MODALITY_TAGS) -> DataFrame:
    """Top-1 model by downloads per listed pipeline tag; a tag without models gives no row."""
    from rankmart.functions.text import org_of, short_name
    from rankmart.operators.dedup import keep_first

    dim = spark.createDataFrame(list(tags), "tag string, label string")
    listed = hub.filter(F.col("pipeline_tag").isin([t for t, _ in tags]))  # before the window, so it reaches the scan
    champ = keep_first(listed.withColumnRenamed("pipeline_tag", "tag"), "tag",
                       [F.col("downloads").desc_nulls_last(), F.col("id").asc()])
    return (champ.join(F.broadcast(dim), "tag")
                 .select("tag", "label", F.col("id").alias("model_id"), short_name("id").alias("model_name"),
                         org_of("id", fixed.NO_ORG).alias("org"),
                         F.coalesce("downloads", F.lit(0)).alias("downloads"),
                         F.coalesce("likes", F.lit(0)).alias("likes")))


def read_leaderboard_page(spark: SparkSession, path: str, category: str = fixed.SWEBENCH_CATEGORY,
                          pattern: str = fixed.SWEBENCH_DATA_PATTERN) -> DataFrame:
    """HTML page -> embedded JSON block -> named category (else the first) -> results.

    Pages without the block give no rows (use ``require_rows`` to fail).
    """
    pages = spark.read.text(path, wholetext=True)
    block = (pages.select(F.regexp_extract("value", pattern, 1).alias("js"),
                          F.col("_metadata.file_name").alias("src_file"), _snapshot(), _fetched_at().alias("fetched_at"))
                  .filter(F.col("js") != ""))
    cats = block.select("src_file", "src_snapshot", "fetched_at", F.from_json("js", LEADERBOARD_DATA).alias("cats"))
    pick = F.coalesce(F.get(F.filter("cats", lambda c: c["name"] == category), 0), F.get(F.col("cats"), 0))
    return (cats.select("src_file", "src_snapshot", "fetched_at", pick.alias("cat"))
                .select("src_file", "src_snapshot", "fetched_at", F.col("cat.name").alias("category"),
                        F.posexplode("cat.results").alias("src_pos", "r"))
                .select("src_file", "src_snapshot", "fetched_at", "category", "src_pos", "r.*"))


def read_package_downloads(spark: SparkSession, path: str) -> DataFrame:
    """One landed JSON per package (S10, U4); corrupt files are skipped, the package
    name comes from the payload or else from the file name."""
    schema = T.StructType(PACKAGE_RECENT.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
           .select("*", F.col("_metadata.file_name").alias("file_name"), _snapshot(), _fetched_at().alias("fetched_at")))
    ok = raw.filter(F.col("_corrupt_record").isNull() & F.col("data").isNotNull())
    pkg = F.coalesce(F.col("package"), F.regexp_extract("file_name", r"^([^.]+)", 1))
    return ok.select(pkg.alias("package"), F.col("file_name").alias("src_file"), "src_snapshot", "fetched_at",
                     F.coalesce("data.last_day", F.lit(0)).alias("last_day"),
                     F.coalesce("data.last_week", F.lit(0)).alias("last_week"),
                     F.coalesce("data.last_month", F.lit(0)).alias("last_month"))


def read_latest_dated_csv(spark: SparkSession, path: str, schema: T.StructType,
                          pattern: str = fixed.ARENA_FILE_PATTERN, manifest: str | None = None) -> DataFrame:
    """Rows of the newest dated file in a folder (S11, X22), with its name and stamp.

    Files are matched by name from the listing (or the folder's manifest); only the newest one (lexical max of
    YYYYMMDD) is opened. Files whose names don't match are none of the feed; without any there are no rows.
    """
    files = list_files(spark, path, pattern) if manifest is None else read_manifest(spark, manifest)
    paths = newest_paths(files.filter(F.col("name").rlike("^" + pattern + "$")))
    if not paths:
        fields = schema.fields + [T.StructField("file_name", T.StringType()), T.StructField("file_stamp", T.StringType())]
        return spark.createDataFrame([], T.StructType(fields))
    df = read_csv(spark, paths, schema).select("*", F.col("_metadata.file_name").alias("file_name"))
    return df.withColumn("file_stamp", F.regexp_extract("file_name", "^" + pattern + "$", 1))


def newest_snapshot(df: DataFrame, key: str | None = None) -> DataFrame:
    """All rows of the newest landed snapshot, overall or per ``key`` (a package, a tag).

    A snapshot is one landing, of any number of files (``src_snapshot``): a ``snapshot=<stamp>`` folder, the part files of
    one write, or a single file. A folder's stamp orders it; other snapshots are ordered by their last file's
    landing time, then by name, and come before stamped ones. Overall the newest is a one-row aggregate
    (broadcast), per key an aggregate joined back on the key; either way every file of it stays.
    """
    by = [] if key is None else [key]
    landed = df.groupBy(*by, "src_snapshot").agg(F.max("fetched_at").alias("_at"))
    newest = landed.groupBy(*by).agg(F.max(F.struct("src_snapshot.stamp", "_at", "src_snapshot.id")).alias("_new"))
    newest = newest.select(*by, F.struct(F.col("_new.stamp").alias("stamp"), F.col("_new.id").alias("id")).alias("_snap"))
    if key is None:
        return df.join(F.broadcast(newest), F.col("src_snapshot") == F.col("_snap"), "left_semi")
    return df.join(newest, [key], "inner").filter(F.col("src_snapshot") == F.col("_snap")).drop("_snap")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail when a source gave nothing usable."""
    if df.isEmpty():
        raise RuntimeError(f"Could not read {what}: no usable rows")
    return df
