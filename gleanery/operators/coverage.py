"""What a mirror holds of a numbered series: copies, gaps, attachments with and without text, shares of published totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import staged


def best_copies(listing: DataFrame, key: str = "key") -> DataFrame:
    """One key for each record id: the one of the highest copy number, of equal ones the first by name."""
    ranked = listing.select(T.comment_id(key).alias("id"), F.col(key).alias("key"), T.copy_rank(key).alias("rank"))
    w = Window.partitionBy("id").orderBy(F.desc("rank"), "key")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "key", "rank")


def gaps(numbers: DataFrame, number: str, by: list[str] | None = None, width: int = 1 << 20) -> DataFrame:
    """(by..., first_missing, last_missing, length): runs of numbers that are missing between two that are there.

    Numbers are cut into ranges of `width`, each looked at alone; the ends of neighbouring ranges, one row each, are then stitched.
    """
    by = by or []
    distinct = numbers.select(*by, F.col(number).cast("long").alias("n")).where("n is not null").distinct()
    ranged = distinct.withColumn("range", F.floor(F.col("n") / width))
    inner = ranged.select(*by, "n", F.lead("n").over(Window.partitionBy(*by, "range").orderBy("n")).alias("next"))
    ends = ranged.groupBy(*by, "range").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    seam = Window.partitionBy(*by).orderBy("range") if by else Window.orderBy("range")
    outer = ends.select(*by, F.col("hi").alias("n"), F.lead("lo").over(seam).alias("next"))
    runs = inner.unionByName(outer).where("next > n + 1")
    return runs.select(*by, (F.col("n") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"), (F.col("next") - F.col("n") - 1).alias("length"))


def density(numbers: DataFrame, number: str, run: int = 5) -> DataFrame:
    """lo, hi, present, holes, runs, longest, in_runs (missing numbers in runs of `run` or more), share."""
    distinct = numbers.select(F.col(number).cast("long").alias("n")).where("n is not null").distinct()
    whole = distinct.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("present"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    holes = gaps(numbers, number).agg(zero(F.sum("length")).alias("holes"), F.count("*").alias("runs"), zero(F.max("length")).alias("longest"), zero(F.sum(F.when(F.col("length") >= run, F.col("length")))).alias("in_runs"))
    return whole.join(F.broadcast(holes)).withColumn("share", F.col("present") / (F.col("present") + F.col("holes")))  # one row each


def attachment_coverage(binaries: DataFrame, texts: DataFrame, key: str = "key") -> DataFrame:
    """One row: records with a file and with a text, files of each kind, what lacks a text, and of that what has no PDF."""
    files = binaries.where(~F.col(key).endswith("/")).select(T.attachment_owner(key).alias("id"), T.extension(key).alias("ext"))
    read = texts.where(~F.col(key).endswith("/")).select(T.attachment_owner(key).alias("id"))
    per = files.groupBy("id").agg(F.count("*").alias("files"), F.bool_or(F.col("ext") == "pdf").alias("pdf"))
    have = read.groupBy("id").agg(F.count("*").alias("texts"))
    both = per.join(have, "id", "full_outer")
    return both.agg(
        F.count_if(F.col("files") > 0).alias("with_binary"),
        F.count_if(F.col("texts") > 0).alias("with_text"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("binary_files"),
        F.coalesce(F.sum("texts"), F.lit(0)).alias("text_files"),
        F.count_if((F.col("files") > 0) & F.col("texts").isNull()).alias("unextracted"),
        F.count_if((F.col("files") > 0) & F.col("texts").isNull() & ~F.col("pdf")).alias("unextracted_without_pdf"),
        F.count_if((F.col("texts") > 0) & F.col("files").isNull()).alias("text_without_binary"),
    )


def top_extensions(binaries: DataFrame, key: str = "key", top: int = 8) -> DataFrame:
    counts = binaries.where(~F.col(key).endswith("/")).groupBy(T.extension(key).alias("ext")).agg(F.count("*").alias("files"))
    return counts.orderBy(F.desc("files"), "ext").limit(top)


def mirror_share(mirror: DataFrame, official: DataFrame, by: str) -> DataFrame:
    """(by, n, official, share, missing); a docket without a published total has nulls."""
    return mirror.join(official, by, "left").select(by, "n", "official", F.try_divide("n", "official").alias("share"), (F.col("official") - F.col("n")).alias("missing"))


def first_missing(present: DataFrame, wanted: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The first `top` values of wanted that present lacks, in order."""
    return wanted.select(column).distinct().join(present.select(column), column, "left_anti").orderBy(column).limit(top)


def walk(entries: DataFrame, by: str = "docket", key: str = "key", modified: str = "last_modified", run: int = 5, top: int = 10) -> DataFrame:
    """One row a docket from one listing of all its objects (by, key, last_modified): records against objects, the newest write, holes in the
    numbering over comments and documents together, attachments, their kinds and their extraction."""
    kind = F.when(F.col(key).contains("/comments/") & F.col(key).endswith(".json"), "comment").when(F.col(key).contains("/documents/") & F.col(key).endswith(".json"), "document")
    kind = kind.when(F.col(key).contains("/comments_attachments/") & ~F.col(key).endswith("/"), "file").when(F.col(key).contains("/comments_extracted_text/") & F.col(key).endswith(".txt"), "text")
    rows = staged(entries.select(by, F.col(key).alias("key"), F.col(modified).alias("modified"), kind.alias("kind")).where("kind is not null"), "listing")
    objects = rows.where("kind in ('comment', 'document')").select(by, "kind", "modified", T.comment_id("key").alias("id"))
    comments = objects.where("kind = 'comment'")
    out = comments.groupBy(by).agg(F.count("*").alias("comment_objects"), F.count_distinct("id").alias("comment_records"), F.max("modified").alias("mirror_newest_write"))
    out = out.withColumn("duplicate_objects", F.col("comment_objects") - F.col("comment_records"))
    out = out.join(objects.where("kind = 'document'").groupBy(by).agg(F.count_distinct("id").alias("documents")), by, "left")
    numbers = staged(objects.select(by, T.sequence_number("id").alias("n")).where("n is not null").distinct(), "numbers")
    span = numbers.groupBy(by).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    length = F.col("length")
    holes = gaps(numbers, "n", [by]).groupBy(by).agg(F.sum(length).alias("holes"), F.max(length).alias("longest_hole_run"), F.sum(F.when(length >= run, length).otherwise(0)).alias("holes_in_runs"))
    out = out.join(span, by, "left").join(holes, by, "left")
    files = rows.where("kind = 'file'").select(by, T.attachment_owner("key").alias("id"), T.extension("key").alias("ext"))
    texts = rows.where("kind = 'text'").select(by, T.attachment_owner("key").alias("id")).groupBy(by, "id").agg(F.count("*").alias("texts"))
    per = files.groupBy(by, "id").agg(F.count("*").alias("files"), F.count_if(F.col("ext") == "pdf").alias("pdfs"))
    both = per.join(texts, [by, "id"], "full_outer")
    lacks = F.col("files").isNotNull() & F.col("texts").isNull()
    out = out.join(both.groupBy(by).agg(
        F.count("files").alias("comments_with_attachment"), F.sum("files").alias("attachment_files"), F.sum("pdfs").alias("pdf_files"), F.sum("texts").alias("extracted_text_files"), F.count("texts").alias("comments_with_extracted_text"),
        F.count_if(lacks & (F.col("pdfs") > 0)).alias("unextracted_pdf_comments"), F.count_if(lacks & (F.col("pdfs") == 0)).alias("unextracted_nonpdf_only_comments"), F.count_if(F.col("texts").isNotNull() & F.col("files").isNull()).alias("extracted_without_binary"),
    ), by, "left")
    kinds = files.groupBy(by, "ext").agg(F.count("*").alias("n"))
    ranked = kinds.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "ext"))).where(F.col("r") <= top)
    out = out.join(ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "ext", "n"))), lambda x: F.concat_ws(":", x["ext"], x["n"].cast("string"))), " ").alias("attachment_ext_counts")), by, "left")
    zero = [c for c in out.columns if c not in (by, "mirror_newest_write", "lo", "hi", "attachment_ext_counts")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
    return out.withColumns({"hole_share": F.round(F.col("holes") / (F.col("hi") - F.col("lo") + 1), 4), "attachment_rate": F.round(F.col("comments_with_attachment") / F.greatest(F.lit(1), F.col("comment_records")), 4)})
