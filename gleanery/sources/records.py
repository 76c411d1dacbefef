"""Listings, records, attachments and labels as DataFrames with explicit schemas, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

# The attributes of a record that are kept, and their types.
ATTRIBUTES = (
    ("comment", "string"),
    ("organization", "string"),
    ("firstName", "string"),
    ("lastName", "string"),
    ("city", "string"),
    ("stateProvinceRegion", "string"),
    ("country", "string"),
    ("email", "string"),
    ("postedDate", "string"),
    ("docketId", "string"),
    ("category", "string"),
    ("fileFormats", "string"),
    ("duplicateComments", "bigint"),
    ("title", "string"),
    ("documentType", "string"),
    ("withdrawn", "boolean"),
    ("modifyDate", "string"),
    ("receiveDate", "string"),
    ("pageCount", "bigint"),
    ("govAgency", "string"),
    ("subtype", "string"),
)
RECORD = "data struct<attributes: struct<" + ", ".join(f"{n}: {t}" for n, t in ATTRIBUTES) + ">, relationships: struct<attachments: struct<data: array<struct<id: string>>>>>"
PAGE_KEY, PAGE_TOKEN = r"<Key>([^<]*)</Key>", r"<NextContinuationToken>([^<]*)</NextContinuationToken>"
PAGE_ENTRY = r"(?s)<Contents>(.*?)</Contents>"
PAGE_TIME = r"<LastModified>([^<]*)</LastModified>"


def parsed_entries(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """(key, last_modified) of every object that an object listing's pages name."""
    one = pages.select(F.explode(F.regexp_extract_all(xml, F.lit(PAGE_ENTRY), F.lit(1))).alias("e"))
    return one.select(F.regexp_extract("e", PAGE_KEY, 1).alias("key"), F.regexp_extract("e", PAGE_TIME, 1).alias("last_modified"))


def parsed_pages(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """(keys, next): an object listing's pages; the token counts only where the page says that it is cut off."""
    more = F.col(xml).rlike(r"<IsTruncated>\s*true\s*</IsTruncated>")
    return pages.select(F.regexp_extract_all(xml, F.lit(PAGE_KEY), F.lit(1)).alias("keys"), F.when(more, F.nullif(F.regexp_extract(xml, PAGE_TOKEN, 1), F.lit(""))).alias("next"))


def listed(listing: DataFrame, prefix: str, suffix: str | None = None, key: str = "key") -> DataFrame:
    """The keys under a prefix, with a suffix if given; both reach the scan."""
    rows = listing.where(F.col(key).startswith(prefix))
    return rows.where(F.col(key).endswith(suffix)) if suffix else rows


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record file: id, key, the kept attributes (null where absent), has_attachment."""
    rows = spark.read.schema(RECORD).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("_key"))
    attributes = [F.col(f"data.attributes.{x}").alias(x) for x, _ in ATTRIBUTES]
    linked = F.coalesce(F.size("data.relationships.attachments.data") > 0, F.lit(False))
    return rows.select(T.comment_id("_key").alias("id"), "_key", *attributes, linked.alias("has_attachment"))


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, chars, text) of extracted text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    return rows.select(T.attachment_owner("file").alias("id"), "file", F.length("text").cast("long").alias("chars"), "text")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, label) from a JSON object of labels."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    return rows.select(F.explode("m").alias("pair_id", "label"))


def read_tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a labelling file: JSON lines after header lines that start with #."""
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.from_json("value", schema).alias("r")).select("r.*")


def corpus(records: DataFrame, attachments: DataFrame, unicode: bool = True) -> DataFrame:
    """Records with the text that represents each: body, attachments in order of file name, or none."""
    joined = attachments.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "text"))).alias("a"))
    rows = records.join(joined, "id", "left").withColumn("texts", F.transform(F.coalesce("a", F.array().cast("array<struct<file: string, text: string>>")), lambda x: x["text"]))
    rows = rows.withColumn("picked", T.assembled("comment", "texts", unicode))
    populated = F.coalesce(F.col("duplicateComments") > 0, F.lit(False))
    keep = [F.col(x) for x in ("organization", "postedDate", "city", "stateProvinceRegion", "category") if x in records.columns]
    return rows.select("id", F.col("picked.text").alias("text"), F.col("picked.source").alias("source"), F.length("picked.text").cast("long").alias("chars"), "duplicateComments", populated.alias("dc_populated"), *keep, F.size("texts").alias("n_attachments"), F.length(F.coalesce("comment", F.lit(""))).alias("body_chars"))


def pair_tasks(sample: DataFrame, texts: DataFrame, excerpt: int = 1200, order: str = "rank") -> DataFrame:
    """A sampled pair (i, j, band, score, order) with a number, both texts' sources, counts and beginnings and an empty label.

    texts: id, text, source, duplicateComments. The labeller sees no machine label. A sample has some 20 rows a band, so it is numbered in one piece.
    """
    side = lambda s: texts.select(F.col("id").alias(f"{s}_id"), F.col("source").alias(f"{s}_source"), F.col("duplicateComments").alias(f"{s}_dupes"), F.substring("text", 1, excerpt).alias(f"{s}_text"))
    number = (F.row_number().over(Window.orderBy("band", order)) - 1).cast("long")
    rows = sample.withColumn("pair", number).withColumnsRenamed({"i": "a_id", "j": "b_id"}).join(side("a"), "a_id").join(side("b"), "b_id")
    return rows.select("pair", "band", "score", F.lit("").alias("label"), "a_id", "b_id", "a_source", "b_source", "a_dupes", "b_dupes", "a_text", "b_text")


def cluster_tasks(sample: DataFrame, members: DataFrame, per_cluster: int = 3, excerpt: int = 600, order: str = "rank") -> DataFrame:
    """A sampled cluster (cluster_id, band, size, order) with a number, its first members' beginnings and an empty label."""
    number = (F.row_number().over(Window.orderBy("band", order)) - 1).cast("long")
    rows = members.join(sample.select("cluster_id", number.alias("cluster"), "band", "size"), "cluster_id")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).where(F.col("r") <= per_cluster)
    first = F.array_sort(F.collect_list(F.struct("id", F.substring("text", 1, excerpt).alias("text"))))
    out = ranked.groupBy("cluster", "cluster_id", "band", "size").agg(first.alias("m"))
    return out.select("cluster", "cluster_id", "band", "size", F.lit("").alias("label"), F.transform("m", lambda x: x["id"]).alias("member_ids"), F.transform("m", lambda x: x["text"]).alias("members"))


def subset(rows: DataFrame, names: list[str], by: str = "docket") -> DataFrame:
    """The rows of the dockets named, or all where none is."""
    return rows.where(F.col(by).isin(names)) if names else rows


def write_rows(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_clean(rows: DataFrame, path: str, text: str = "text_clean") -> None:
    """The texts that were clustered: id, text, duplicateComments."""
    write_rows(rows.select("id", F.col(text).alias("text"), "duplicateComments"), path)


def write_vectors(vectors: DataFrame, path: str, vector: str = "vec") -> None:
    """(id, vec) with 32-bit numbers."""
    vectors.select("id", F.col(vector).cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def write_tasks(tasks: DataFrame, path: str, header: list[str]) -> None:
    """JSON lines at path, and the header beside them."""
    tasks.write.mode("overwrite").json(path)
    tasks.sparkSession.createDataFrame([(f"# {x}",) for x in header], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "-header")
