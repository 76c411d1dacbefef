"""Labels of pairs: what counts as a merge, which labels count, two and more labellers, and how much one label decides.

Labelled sets are made by hand, so one of them fits a row; the tables that they are joined with need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import minhash as M
from gleanery.operators import evaluate

UNUSABLE, SAME = ("unusable",), ("same",)
#: Fixed value: kappa under which a judge's labels carry no finding.
LEAST_KAPPA = 0.6


def merges(rung: str, a: Column, b: Column, threshold: float | None = None) -> Column:
    """Whether a rung merges two documents, from their keys, signatures or vectors."""
    if rung == "exact":
        return a == b
    if rung == "near":
        return M.agreement(a, b) >= threshold
    if rung == "semantic":
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) >= threshold
    raise ValueError(rung)


def usable(labels: DataFrame, label: str = "label", ignore: tuple[str, ...] = UNUSABLE) -> DataFrame:
    """Rows with a label that isn't to be left out; a null label is none."""
    return labels.where(F.col(label).isNotNull() & ~F.col(label).isin(*ignore))


def binary(label: Column, positive: tuple[str, ...] = SAME) -> Column:
    """merge or keep: the decision that the pipeline makes."""
    return F.when(label.isin(*positive), "merge").otherwise("keep")


def labelled(labels: DataFrame, sample: DataFrame, key: str = "pair", label: str = "label", positive: tuple[str, ...] = SAME) -> DataFrame:
    """The sample's rows that have a usable label, with it and whether it is positive."""
    rows = usable(labels, label).select(key, label, F.col(label).isin(*positive).alias("positive"))
    return sample.join(rows, key)


def agreement_report(rows: DataFrame, key: str, a: str, b: str, repeats: int = 2000, seed: int = 3) -> DataFrame:
    """One row: pairs compared, raw agreement and kappa over all labels and as merge or keep, kappa's interval, disagreements, verdict."""
    two = (F.col(a), F.col(b))
    as_binary = tuple(binary(c) for c in two)
    seen = evaluate.kappas(rows, {"raw": two, "merge": as_binary})
    ratio = lambda view: F.round(F.try_divide(F.col(f"{view}.agree"), F.col(f"{view}.n")), 4)
    whole = seen.select(
        F.col("raw.n").alias("pairs_compared"), ratio("raw").alias("raw_agreement"), F.round("raw.kappa", 4).alias("kappa"), (F.col("raw.n") - F.col("raw.agree")).alias("disagreements"),
        ratio("merge").alias("raw_merge"), F.round("merge.kappa", 4).alias("kappa_merge"),
    )
    as_bits = rows.select(key, *((x == "merge").cast("int").alias(c) for x, c in zip(as_binary, ("a", "b"), strict=True)))
    interval = evaluate.bootstrap_kappa(as_bits, key, "a", "b", repeats, seed).select(F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))
    out = whole.join(F.broadcast(interval))  # one row
    verdict = F.when(F.col("kappa_merge").isNull(), "nothing to compare").when(F.col("kappa_merge") < LEAST_KAPPA, "human labels only").otherwise("beside the precision")
    return out.withColumn("verdict", verdict)


def disagreements(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return rows.where(~F.col(a).eqNullSafe(F.col(b))).select(key, a, b)


def agent_matrix(rows: DataFrame, key: str, agent: str, label: str) -> DataFrame:
    """(a, b, n, agree, kappa) of every two labellers, from rows (key, agent, label)."""
    x, y = rows.select(key, F.col(agent).alias("a"), F.col(label).alias("la")), rows.select(key, F.col(agent).alias("b"), F.col(label).alias("lb"))
    met = x.join(y, key).where("a < b")
    cells = met.groupBy("a", "b", "la", "lb").agg(F.count("*").alias("c"))
    left = cells.groupBy("a", "b", F.col("la").alias("l")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy("a", "b", F.col("lb").alias("l")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, ["a", "b", "l"]).groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("chance"))
    total = cells.groupBy("a", "b").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("agree"))
    both = total.join(chance, ["a", "b"], "left").withColumn("chance", F.coalesce("chance", F.lit(0)))
    n = F.col("n").cast("double")
    value = F.when(F.col("chance") == F.col("n") * F.col("n"), 1.0).otherwise((F.col("agree") / n - F.col("chance") / (n * n)) / (1 - F.col("chance") / (n * n)))
    return both.select("a", "b", "n", "agree", value.alias("kappa"))


def unanimous(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(unanimous, n): how many keys all labellers give one label."""
    per = rows.groupBy(key).agg((F.min(label) == F.max(label)).alias("one"))
    return per.agg(F.count_if("one").alias("unanimous"), F.count("*").alias("n"))


def perturbed_thresholds(rows: DataFrame, key: str, score: str, positive: Column, least: float = 1.0) -> DataFrame:
    """(key, left_out, flipped): the threshold that would be selected without each label, and with it turned round.

    Only sums at scores up to a label's own change, so the curve, one row's array, is looked through once a label.
    """
    own = rows.select(key, F.col(score).cast("double").alias("score"), F.when(positive, 1).otherwise(0).alias("p"))
    by = own.groupBy("score").agg(F.sum("p").alias("p"), F.count("*").alias("c"))
    down = Window.orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    curve = by.select("score", "c", F.sum("p").over(down).alias("tp"), F.sum("c").over(down).alias("n"))
    curve = curve.agg(F.collect_list(F.struct("score", "c", "tp", "n")).alias("curve"))

    def chosen(tp, n) -> Column:
        """The least score whose precision holds; tp and n are what a label of this score takes away at its own score and below."""

        def holds(x: Column) -> Column:
            below = x["score"] <= F.col("score")
            left, all_left = x["tp"] - F.when(below, tp).otherwise(0), x["n"] - F.when(below, n).otherwise(0)
            there = ~((x["score"] == F.col("score")) & (x["c"] <= n))  # a score that nothing is left of is none
            return there & (all_left > 0) & (left / all_left >= least)

        return F.array_min(F.transform(F.filter("curve", holds), lambda x: x["score"]))

    p = F.col("p")
    return own.join(F.broadcast(curve)).select(key, chosen(p, F.lit(1)).alias("left_out"), chosen(2 * p - 1, F.lit(0)).alias("flipped"))  # curve: one row
