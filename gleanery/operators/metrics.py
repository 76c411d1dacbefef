"""What clusters say about a corpus: submissions, cluster sizes, rungs of the ladder, the margin over a published count.

A count that no record carries is unknown, never 1 (null totals). Ratios aren't rounded here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def submissions(count: str) -> dict[str, Column]:
    """Aggregates over records: total (null if nobody carries a count), how many carry more than 1, records, populated."""
    v = F.col(count)
    populated = F.coalesce(F.bool_or(v > 0), F.lit(False))
    total = F.sum(F.when(v > 0, v).otherwise(1)).cast("long")
    return {"total": F.when(populated, total), "populated_records": F.count_if(v > 1), "records": F.count("*"), "field_populated": populated}


def cluster_stats(members: DataFrame, by: list[str], count: str | None = None) -> DataFrame:
    """From (by..., cluster_id[, count]): clusters, records, largest by records and by counts (null and 0 add nothing), singletons, multi."""
    total = F.sum(F.coalesce(F.col(count), F.lit(0))) if count else F.count("*")
    per = members.groupBy(*by, "cluster_id").agg(F.count("*").alias("n"), total.cast("long").alias("subs"))
    aggs = [F.count("*").alias("clusters"), F.sum("n").alias("records"), F.max("n").alias("largest_records"), F.max("subs").alias("largest_submissions"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi")]
    return per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)


def ladder(stats: DataFrame, rung: str) -> DataFrame:
    """A rung's row: how far its clusters collapse the records."""
    n, k = F.col("records"), F.greatest(F.lit(1), F.col("clusters"))
    return stats.withColumns({"rung": F.lit(rung), "collapse_vs_records": n / k, "extra_collapse_pct": 100 * (1 - F.col("clusters") / F.greatest(F.lit(1), n))})


def margin(stats: DataFrame) -> DataFrame:
    """From total, records, clusters: the published collapse, what clusters add, both together, the share that is published."""
    total, n, k = F.col("total"), F.col("records"), F.greatest(F.lit(1), F.col("clusters"))
    own = n / k - 1
    whole = F.greatest(F.lit(1e-9), total / k - 1)
    return stats.withColumns({"official_collapse": total / F.greatest(F.lit(1), n), "additional_collapse": n / k, "total_collapse": total / k, "official_share": F.when(total.isNotNull(), 1 - own / whole)})
