"""Readers; all give DataFrames, with empty texts as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.scalar import coerce_time


def _blank(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in sorted(df.dtypes)])


def submission(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object whose ``data`` is the array of events; columns sorted."""
    reader = spark.read.option("multiLine", True)
    whole = (reader.schema(T.StructType([T.StructField("data", T.ArrayType(schema))])) if schema else reader).json(path)
    return _blank(whole.select(F.explode("data").alias("e")).select("e.*"))


def records(spark: SparkSession, path: str, schema: T.StructType | None = None, array: bool = False) -> DataFrame:
    """JSON records, one a line, or an array in one file."""
    reader = spark.read.option("multiLine", array)
    return _blank((reader.schema(schema) if schema else reader).json(path))


def events_csv(spark: SparkSession, path: str, header: bool = True, **options) -> DataFrame:
    return _blank(spark.read.options(header=header, **options).csv(path))


def github_positional(spark: SparkSession, path: str) -> DataFrame:
    """CSV of time, event, user, repo and perhaps action and merged, by position; ``_id`` goes, time is floored to the hour."""
    df = spark.read.option("header", True).csv(path)
    df = df.drop("_id")
    names = ["ts", "event", "user", "content", "action", "merged"][: len(df.columns)]
    df = _blank(df.toDF(*names))
    return df.withColumn("ts", coerce_time(F.col("ts"), "string")).withColumn("time", F.date_trunc("hour", "ts")).withColumn("root", F.col("content")).withColumn("seq", F.xxhash64(*names))


def node_list(spark: SparkSession, path: str | None, missing: list[str] | None = None) -> DataFrame | list[str]:
    """Ids, one a line; ``missing`` (["all"] by default) where there is no file."""
    if path is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.text(path).filter("trim(value) != ''").select(F.trim("value").alias("id"))
    return ["all"] if missing is None else missing


def metadata(spark: SparkSession, path: str, kind: str, log: DataFrame | None = None) -> DataFrame:
    """CSV by position: content (root, created_at, owner, language) or user (user, created_at, and location, company or city, country, company); rows of the log only."""
    df = spark.read.option("header", True).csv(path)
    if kind == "content":
        df = df.toDF(*["root", "created_at", "owner", "language"][: len(df.columns)])
    else:
        df = df.toDF(*(["user", "created_at", "location", "company"] if len(df.columns) <= 4 else ["user", "created_at", "city", "country", "company"])[: len(df.columns)])
    df = _blank(df).withColumn("created_at", coerce_time(F.col("created_at"), "string"))
    key = "root" if kind == "content" else "user"
    return df if log is None else df.join(log.select(key).distinct(), key, "left_semi")


def previous_counts(spark: SparkSession, path: str) -> DataFrame:
    """CSV of user, content and count before the log begins."""
    return spark.read.option("header", True).csv(path).toDF("user", "root", "value").withColumn("value", F.col("value").cast("double"))


def communities(spark: SparkSession, path: str) -> DataFrame:
    """JSON {type: {community: [ids]}} as (ctype, community, id)."""
    text = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string, map<string, array<string>>>")
    one = text.select(F.explode(m).alias("ctype", "c")).select("ctype", F.explode("c").alias("community", "ids"))
    return one.select("ctype", "community", F.explode("ids").alias("id"))


def keyword_aliases(spark: SparkSession, path: str) -> DataFrame:
    """JSON {name: [aliases]} as (name, alias), names being aliases of themselves."""
    m = F.from_json("value", "map<string, array<string>>")
    df = spark.read.option("wholetext", True).text(path).select(F.explode(m).alias("name", "a")).select("name", F.explode(F.array_union("a", F.array("name"))).alias("alias"))
    return df.distinct()


def followers(spark: SparkSession, path: str) -> DataFrame:
    """A folder of ``<user>.txt``, one follower a line, or JSON {user: [followers]}: (user, follower)."""
    if path.endswith(".json"):
        m = F.from_json("value", "map<string, array<string>>")
        return spark.read.option("wholetext", True).text(path).select(F.explode(m).alias("user", "f")).select("user", F.explode("f").alias("follower"))
    rows = spark.read.text(f"{path.rstrip('/')}/*.txt").select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("follower"))
    return rows.filter("follower != ''").select(F.regexp_replace("file", r"\.txt$", "").alias("user"), "follower")


def influence_parameters(spark: SparkSession, path: str) -> dict:
    """The JSON of transfer-entropy settings: startTime, binSize, teThresh, delayUnits, starEvent, otherEvents, kE, kN, nReps."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True) if row else {}
