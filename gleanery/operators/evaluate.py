"""Labels against predictions: confusion, kappa with its interval, thresholds, stratified samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import staged


def confusion(rows: DataFrame, positive: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; a ratio without a denominator is null, and so is f1 without both or with a zero."""
    count = lambda c, name: F.count_if(c).alias(name)
    one = rows.agg(count(predicted & positive, "tp"), count(predicted & ~positive, "fp"), count(~predicted & positive, "fn"), count(~predicted & ~positive, "tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return one.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def kappas(rows: DataFrame, views: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row with n, agree and Cohen's kappa of each view's two columns, a struct a view: kappa is null without rows, 1 where chance agreement is full.

    All views take one scan, and a label's counts on both sides meet in a grouping, so that nothing is joined or broadcast.
    """
    sides = [(f"{view}_{i}", c) for view, two in views.items() for i, c in enumerate(two)]
    agrees = [F.when(F.col(f"{view}_0") == F.col(f"{view}_1"), F.col("c")).otherwise(0).alias(f"{view}_same") for view in views]
    cells = rows.groupBy(*(c.alias(name) for name, c in sides)).agg(F.count("*").alias("c")).select("*", *agrees)
    # the counts of each side's labels; a grouping's number has a 0 bit for the column that it keeps
    each = cells.groupingSets([[F.col(name)] for name, _ in sides], *(F.col(name) for name, _ in sides)).agg(F.grouping_id().alias("g"), F.sum("c").alias("c"), *(F.sum(f"{view}_same").alias(f"{view}_same") for view in views))
    kept = {name: F.col("g") == (1 << len(sides)) - 1 - (1 << len(sides) - 1 - i) for i, (name, _) in enumerate(sides)}
    of = lambda name, value: F.sum(F.when(kept[name], F.col(value)).otherwise(0)).alias(f"{name}_{value}")
    labels = [F.coalesce(f"{view}_0", f"{view}_1").alias(f"{view}_label") for view in views]
    met = each.groupBy(*labels).agg(*(of(name, "c") for name, _ in sides), *(of(f"{view}_0", f"{view}_same") for view in views))
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    one = met.agg(
        *(total(F.col(f"{view}_0_c")).alias(f"{view}_n") for view in views),
        *(total(F.col(f"{view}_0_{view}_same")).alias(f"{view}_agree") for view in views),
        *(total(F.when(F.col(f"{view}_label").isNotNull(), F.col(f"{view}_0_c") * F.col(f"{view}_1_c"))).alias(f"{view}_chance") for view in views),
    )

    def value(view: str) -> Column:
        n, chance = F.col(f"{view}_n").cast("double"), F.col(f"{view}_chance")
        po, pe = F.col(f"{view}_agree") / n, chance / (n * n)
        return F.when(n == 0, None).when(chance == n * n, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))

    return one.select(*(F.struct(F.col(f"{view}_n").alias("n"), F.col(f"{view}_agree").alias("agree"), value(view).alias("kappa")).alias(view) for view in views))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agree and Cohen's kappa: null without rows, 1 where chance agreement is full."""
    return kappas(rows, {"both": (F.col(a), F.col(b))}).select("both.*")


def draw(repeat: Column, place: Column, n: Column, seed: int) -> Column:
    """Which of n rows a place of a resample takes: a hash, so that any engine draws the same."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), repeat.cast("string"), place.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % n


#: Draws of a task, about, and draws that are hashed together: their numbers stay in a core's cache.
TASK_DRAWS, TOGETHER = 1 << 21, 1 << 14
#: Labels in a row of packed ones.
PACKED = 1 << 20
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _first_word(m: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits of MD5 sums of messages of one block, given as its 16 words; their shapes are broadcast."""
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    start = a
    for i in range(61):  # the last three of 64 steps leave the first word as it is
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        x = f + a + (m[g] + _SINES[i])
        a, d, c, b = d, c, b, b + (x << np.uint32(_SHIFTS[i]) | x >> np.uint32(32 - _SHIFTS[i]))
    return start + b


def _by_digits(lo: int, hi: int, most: int) -> Iterator[tuple[int, int, int]]:
    """The numbers from lo below hi in runs of at most `most` with equally many digits: start, end, digits."""
    while lo < hi:
        digits = len(str(lo))
        end = min(hi, lo + most, 10**digits)
        yield lo, end, digits
        lo = end


def _write(m: list[np.ndarray], values: np.ndarray, digits: int, at: int) -> None:
    """Put the values' decimal digits into the messages' words, from byte `at` on."""
    for i in range(digits):
        byte = (values // 10 ** (digits - 1 - i) % 10 + 48).astype(np.uint32)
        m[(at + i) // 4] = m[(at + i) // 4] | byte << np.uint32(8 * ((at + i) % 4))


def draws(first: int, last: int, n: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """draw() for all n places of the resamples from first below last: blocks of the first resample's number and a row for each."""
    for p_lo, p_hi, p_digits in _by_digits(0, n, TOGETHER):
        for r_lo, r_hi, r_digits in _by_digits(first, last, max(1, TOGETHER // (p_hi - p_lo))):
            prefix = f"{seed}:".encode()
            colon = len(prefix) + r_digits
            size = colon + 1 + p_digits
            message = bytearray(64)
            message[: len(prefix)], message[colon], message[size], message[56:58] = prefix, 58, 128, (8 * size).to_bytes(2, "little")
            m = [x.reshape(1, 1) for x in np.frombuffer(bytes(message), np.uint32)]
            _write(m, np.arange(r_lo, r_hi)[:, None], r_digits, len(prefix))
            _write(m, np.arange(p_lo, p_hi)[None, :], p_digits, colon + 1)
            yield r_lo, (_first_word(m).byteswap() >> np.uint32(4)).astype(np.int64) % n


def _packed(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(part, seq, n, codes): the labels in the key's order, a byte each: 1 if they agree, 2 if a is 1, 4 if b is 1; a null label is neither."""
    code = F.when(F.col(a) == F.col(b), 1).otherwise(0) + F.when(F.col(a) == 1, 2).otherwise(0) + F.when(F.col(b) == 1, 4).otherwise(0)
    ordered = rows.orderBy(F.col(key).asc_nulls_last(), a, b).select(code.cast("byte").alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["part", "seq", "n", "codes"])

        for batch in batches:
            held.append(np.asarray(batch.column(0)).tobytes())
            n += batch.num_rows
            if n >= PACKED:
                yield row()
                seq, held, n = seq + 1, [], 0
        if n:
            yield row()

    return ordered.mapInArrow(run, "part int, seq int, n long, codes binary")


def bootstrap_kappa(rows: DataFrame, key: str, a: str, b: str, repeats: int = 2000, seed: int = 3) -> DataFrame:
    """(low, high): the 2.5 and 97.5 per cent places of kappa over resamples of a labelled set; null under 5 rows.

    Binary labels 0/1, in the key's order, nulls last. A task takes whole resamples, about TASK_DRAWS draws of them, with a byte for each
    label, so that no row is made for a draw: draw()'s hashes are taken by numpy, and what leaves a task are a resample's counts.
    """
    spark = rows.sparkSession
    packed = staged(_packed(rows, key, a, b), "labels")
    n = packed.agg(F.sum("n").alias("n")).first()["n"] or 0
    if n < 5:
        return spark.createDataFrame([(None, None)], "low double, high double")
    each = max(1, TASK_DRAWS // n)
    jobs = -(-repeats // each)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        code = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8)
        first = table["job"][0].as_py() * each
        last = min(first + each, repeats)
        counts = np.zeros((last - first, 8), np.int64)
        for r, k in draws(first, last, n, seed):
            own = code[k] + 8 * np.arange(len(k))[:, None]
            counts[r - first : r - first + len(k)] += np.bincount(own.ravel(), minlength=8 * len(k)).reshape(-1, 8)
        bit = np.arange(8)
        agree, sa, sb = (counts[:, bit & x > 0].sum(axis=1) for x in (1, 2, 4))
        return pa.table({"agree": agree, "sa": sa, "sb": sb})

    dealt = spark.range(jobs).withColumnRenamed("id", "job").crossJoin(packed.select("part", "seq", "codes"))
    s = dealt.repartition(jobs, "job").groupBy("job").applyInArrow(run, "agree long, sa long, sb long")
    chance = F.col("sa") * F.col("sb") + (n - F.col("sa")) * (n - F.col("sb"))
    value = F.when(chance == n * n, 1.0).otherwise((F.col("agree") * n - chance) / (F.lit(n * n) - chance).cast("double"))
    ordered = s.select(value.alias("v")).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return ordered.select(F.get("v", F.lit(int(0.025 * repeats))).alias("low"), F.get("v", F.lit(int(0.975 * repeats))).alias("high"))


def precision_by_threshold(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """(score, tp, n, precision) at each distinct score, ties counted together."""
    by = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count("*").alias("c"))
    down = Window.orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    return by.select("score", F.sum("p").over(down).alias("tp"), F.sum("c").over(down).alias("n")).withColumn("precision", F.col("tp") / F.col("n"))


def select_threshold(rows: DataFrame, score: str, positive: Column, least: float = 1.0) -> DataFrame:
    """(threshold,): the lowest score at which precision reaches `least`, whatever happens in between; null if none does."""
    return precision_by_threshold(rows, score, positive).agg(F.min(F.when(F.col("precision") >= least, F.col("score"))).alias("threshold"))


def admissible_range(rows: DataFrame, score: str, positive: Column, least: float = 1.0) -> DataFrame:
    """(top_negative, selected, width, positives): the room for a threshold above the highest negative."""
    chosen = select_threshold(rows, score, positive, least)
    top = rows.agg(F.coalesce(F.max(F.when(~positive, F.col(score))), F.lit(0.0)).alias("top_negative"))
    one = top.join(F.broadcast(chosen))  # one row each
    held = rows.join(F.broadcast(one)).agg(F.first("top_negative").alias("top_negative"), F.first("threshold").alias("selected"), F.count_if(positive & (F.col(score) > F.col("top_negative"))).alias("positives"))
    return held.select("top_negative", "selected", (F.col("selected") - F.col("top_negative")).alias("width"), "positives")


def stratified(rows: DataFrame, band: str, order: Column, per_band: int) -> DataFrame:
    """Up to per_band rows of each band in a seeded order, with the band's population."""
    w = Window.partitionBy(band)
    ranked = rows.withColumns({"rank": F.row_number().over(w.orderBy(order)), "population": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= per_band)


#: Where score bands begin, and where the last one ends.
SCORE_CUTS = (0.60, 0.70, 0.80, 0.85, 0.90, 0.95, 0.99, 1.01)


def score_band(score: Column) -> Column:
    """Half-open bands from 0.60; null below."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(SCORE_CUTS, SCORE_CUTS[1:], strict=False):
        out = F.when((score >= lo) & (score < hi), f"{lo:.2f}-{hi:.2f}").otherwise(out)
    return out


def size_band(n: Column) -> Column:
    """Closed bands of cluster sizes; null for one member."""
    return F.when(n < 2, None).when(n <= 3, "2-3").when(n <= 10, "4-10").when(n <= 50, "11-50").when(n <= 500, "51-500").otherwise("501-max")
