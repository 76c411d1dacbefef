"""The whole ladder over a corpus of dockets: assemble, clean, exact, near and semantic rungs, margins, one row a docket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import minhash as M
from gleanery.functions import text as T
from gleanery.operators import linkage, metrics
from gleanery.operators.components import connected_components
from gleanery.session import staged

# The thresholds of the near and the semantic rung.
JACCARD, COSINE = 80 / 128, 0.9641


def usable(corpus: DataFrame) -> DataFrame:
    """Rows with a source and a text that cleaning leaves something of; text_clean is what is clustered."""
    return corpus.where("source <> 'none'").withColumn("text_clean", T.clean("text")).where("text_clean <> ''")


def funnel(corpus: DataFrame, by: str) -> DataFrame:
    """records, no_text, emptied and usable of each docket, counted before anything is dropped."""
    marked = corpus.select(by, (F.col("source") == "none").alias("none"), (T.clean("text") == "").alias("empty"))
    return marked.groupBy(by).agg(F.count("*").alias("records"), F.count_if("none").alias("no_text"), F.count_if(~F.col("none") & F.col("empty")).alias("emptied"), F.count_if(~F.col("none") & ~F.col("empty")).alias("usable"))


def run(corpus: DataFrame, by: str, vectors: DataFrame | None = None, near: float = JACCARD, cosine: float = COSINE, permutations: int = 128) -> DataFrame:
    """One row a docket with the clusters of each rung. corpus: id, by, text, source, duplicateComments; vectors: id, vec.

    Texts that are equal in canonical form are one point for the near rung, and so are texts of equal signatures.
    Signatures, pairs and linkage run once over all dockets; a docket's name in the band key keeps dockets apart. With vectors there are
    the semantic rung, its graph's figures and the margin over the published count. Where components are too large for
    complete linkage, the rung's linkage says so.
    """
    rows = staged(usable(corpus).select("id", by, "text_clean", "duplicateComments", T.exact_key("text_clean").alias("key")), "usable")
    heads = rows.groupBy(by, "key").agg(F.min("id").alias("head"))
    members = staged(rows.join(heads, [by, "key"]).select("id", by, "head", "duplicateComments"), "members")
    texts = rows.join(members.where("id = head").select("id"), "id").select("id", by, "text_clean")
    signed = staged(M.portable_signatures(texts, "id", "text_clean", permutations, keep=(by,)), "signed")
    alike = staged(M.classes(signed, (by,)), "classes")
    points = staged(signed.join(alike.where("id = head").select("id"), "id"), "points")
    pairs = staged(M.near_pairs(points, near, permutations // 4, 4, (by,)), "pairs")
    own = points.select("id", "sig", F.col("id").cast("string").alias("same"))
    at_head = lambda found: alike.select("id", "head").join(found.withColumnRenamed("id", "head"), "head").select(F.col("id").alias("head"), "cluster_id", "linkage")
    single = connected_components(pairs, "i", "j").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"))
    single = points.select("id").join(single, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"), F.lit("single").alias("linkage"))
    complete = staged(at_head(linkage.near_clusters(own, pairs, near)), "near")
    out = _rung(members.withColumn("cluster_id", F.col("head")), by, "exact")
    out = out.join(_rung(members.join(at_head(single), "head"), by, "near_single"), by).join(_rung(members.join(complete, "head"), by, "near"), by)
    out = out.join(_linkage(members.join(complete, "head"), by, "near_linkage"), by)
    counts = staged(rows.groupBy(by).agg(*(c.alias(k) for k, c in metrics.submissions("duplicateComments").items())), "counts")
    if vectors is not None:
        v = staged(vectors.join(rows.select("id", by, F.col("key").alias("same"), "duplicateComments"), "id").withColumn("same", F.concat_ws("|", by, "same")), "vectors")
        near_pairs = staged(linkage.cosine_pairs(v.select("id", "vec", by), cosine, by=by), "cosines")
        semantic = staged(v.select("id", by, "duplicateComments").join(linkage.semantic_clusters(v.select("id", "vec", "same"), near_pairs, cosine), "id"), "semantic")
        out = out.join(_rung(semantic, by, "semantic"), by, "left").join(_linkage(semantic, by, "semantic_linkage"), by, "left")
        out = out.join(linkage.graph_figures(v, near_pairs, by), by, "left")
        own_counts = semantic.groupBy(by).agg(*(c.alias(k) for k, c in metrics.submissions("duplicateComments").items()), F.count_distinct("cluster_id").alias("clusters"))
        out = out.join(metrics.margin(own_counts).select(by, *MARGIN), by, "left")
    out = out.withColumns({"cosine_threshold": F.lit(cosine), "jaccard_threshold": F.lit(near)})
    return funnel(corpus, by).withColumnRenamed("records", "all_records").join(counts, by, "left").join(out, by, "left")


MARGIN = ("official_collapse", "additional_collapse", "total_collapse", "official_share")


def _rung(members: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name_...): clusters, the largest one, how far they collapse the records and by what share."""
    stats = metrics.ladder(metrics.cluster_stats(members, [by]), name)
    return stats.select(by, *(F.col(c).alias(f"{name}_{to}") for c, to in (("clusters", "clusters"), ("largest_records", "largest"), ("collapse_vs_records", "collapse_vs_records"), ("extra_collapse_pct", "extra_collapse_pct"))))


def _linkage(members: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): "complete", or how many of the clusters are whole components beyond the limit, and their sizes."""
    large = members.where("linkage = 'single'").groupBy(by, "cluster_id").agg(F.count("*").alias("n"))
    sizes = large.groupBy(by).agg(F.count("*").alias("c"), F.sort_array(F.collect_list("n")).cast("string").alias("sizes"))  # few: each has thousands of members
    flag = F.when(F.col("c").isNull(), "complete").otherwise(F.format_string("MIXED: %d component(s) by single linkage, sizes %s", "c", "sizes"))
    return members.select(by).distinct().join(sizes, by, "left").select(by, flag.alias(name))
