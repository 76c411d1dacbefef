"""MinHash signatures of shingle sets, portable (built-ins only) and exact to the bit (numpy), and their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import staged

MODULUS = (1 << 31) - 1
MERSENNE = (1 << 61) - 1


def coefficients(n: int) -> list[tuple[int, int]]:
    """(a, b) of each permutation, from two multiplicative sequences modulo MODULUS."""
    out, a, b = [], 1, 1
    for _ in range(n):
        a, b = a * 48271 % MODULUS, b * 69621 % MODULUS
        out.append((a, b))
    return out


def portable_hash(shingle: Column) -> Column:
    """28 bits of MD5, which every SQL engine has; a * h + b then fits 64 bits."""
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 7), 16, 10).cast("long")


def exploded(docs: DataFrame, id_column: str, text_column: str, k: int = 5) -> DataFrame:
    """(id, shingle), one row a distinct shingle; a text without words has one row with a null."""
    return docs.select(F.col(id_column).alias("id"), F.explode_outer(T.shingles_of(T.words(text_column), k)).alias("shingle"))


def portable_signatures(docs: DataFrame, id_column: str, text_column: str, n: int = 128, k: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, sig, keep...): minima over permutations; texts without words get MODULUS everywhere. No shuffle: a text's shingles stay in its row."""
    hashes = F.transform(T.shingles_of(T.words(text_column), k), portable_hash)
    pairs = np.array(coefficients(n), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = pairs.T
        for batch in batches:
            rows = []
            for h in batch.column(1):
                x, least = np.asarray(h.values, np.int64), np.full(n, MODULUS, np.int64)
                for lo in range(0, len(x), 4096):
                    least = np.minimum(least, ((x[lo : lo + 4096, None] * a + b) % MODULUS).min(axis=0))
                rows.append(least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64())), *batch.columns[2:]], names=["id", "sig", *keep])

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col(id_column).cast("long").alias("id"), hashes.alias("h"), *keep).mapInArrow(run, "id long, sig array<long>" + kept)


class ExactHasher:
    """Signatures to the bit: 64-bit products that wrap before the modulus, permutations from a seeded generator."""

    def __init__(self, n: int = 128, seed: int = 17):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, MERSENNE, size=n, dtype=np.uint64)
        self.b = draw.integers(0, MERSENNE, size=n, dtype=np.uint64)

    def signature(self, shingles) -> np.ndarray:
        if not len(shingles):
            return np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        digests = b"".join(hashlib.blake2b(s.encode(), digest_size=8).digest() for s in shingles)
        h = np.frombuffer(digests, ">u8").astype(np.uint64) % np.uint64(MERSENNE)
        return np.array([((h * a % np.uint64(MERSENNE) + b) % np.uint64(MERSENNE)).min() for a, b in zip(self.a, self.b, strict=True)])


def exact_signatures(docs: DataFrame, id_column: str, text_column: str, n: int = 128, seed: int = 17, k: int = 5) -> DataFrame:
    """(id, sig) with the unsigned 64-bit values' bit patterns as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ExactHasher(n, seed)
        for batch in batches:
            signed = [hasher.signature(x).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.list_(pa.int64()))], names=["id", "sig"])

    # a step of its own: as a function of a column that holds a lambda it would be moved into the lambda's plan and fail
    sets = docs.select(F.col(id_column).cast("long").alias("id"), T.shingles_of(T.words(F.col(text_column)), k).alias("shingles"))
    return sets.mapInArrow(run, "id long, sig array<long>")


def agreement(a: Column, b: Column) -> Column:
    """The share of equal places: the estimate of Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def bands(signatures: DataFrame, n_bands: int = 32, rows: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(band, key, id, keep...): one row for each band of a signature."""
    key = lambda i: F.array_join(F.transform(F.slice("sig", i * rows + 1, rows), lambda x: x.cast("string")), "-")
    each = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(i.alias("band"), key(i).alias("key")))
    return signatures.select("id", *keep, F.explode(each).alias("b")).select("b.band", "b.key", "id", *keep)


def classes(signatures: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, head, by...): the first id of equal signature (within by): such texts can't be told apart and need one row in a bucket."""
    heads = signatures.groupBy("sig", *by).agg(F.min("id").alias("head"))
    return signatures.join(heads, ["sig", *by]).select("id", "head", *by)


def candidates(banded: DataFrame) -> DataFrame:
    """Distinct pairs i < j of rows (band, key, id) that share a band's key. Give it one row a class: copies would all be paired."""
    x, y = banded.alias("x"), banded.alias("y")
    return x.join(y, ["band", "key"]).where("x.id < y.id").select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).distinct()


def near_pairs(signatures: DataFrame, threshold: float, n_bands: int = 32, rows: int = 4, by: tuple[str, ...] = (), largest: int = 200) -> DataFrame:
    """(i, j, score) of all pairs of (id, sig, by...) that share a band's key (within by) and agree in `threshold` of their places.

    signatures holds one row a class (classes()). Buckets up to `largest` are joined with themselves and then scored; members of a larger
    one are dealt in blocks, each two blocks meet in a task, and only pairs that hold leave it: no bucket's size bounds what is found.
    """
    banded = bands(signatures, n_bands, rows, by)
    sizes = banded.groupBy("band", "key", *by).agg(F.count("*").alias("n")).where("n > 1")
    known = banded.join(sizes, ["band", "key", *by])
    small = known.where(F.col("n") <= largest).select(F.concat_ws("|", *by, "key").alias("key"), "band", "id")
    out = scored(candidates(small), signatures).where(F.col("score") >= threshold)
    blocks = F.ceil(F.col("n") / largest).cast("long")
    dealt = known.where(F.col("n") > largest).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).join(signatures.select("id", "sig"), "id")

    def meet(rows: pa.Table) -> pa.Table:
        ids, block = np.asarray(rows["id"]), np.asarray(rows["block"])
        sig = np.stack([np.asarray(x.values) for x in rows["sig"]])
        left, right = np.flatnonzero(block == rows["lo"][0].as_py()), np.flatnonzero(block == rows["hi"][0].as_py())
        found: list[tuple] = []
        for a in left.tolist():
            score = (sig[right] == sig[a]).sum(axis=1) / sig.shape[1]
            found += [(min(ids[a], ids[b]), max(ids[a], ids[b]), s) for b, s in zip(right[score >= threshold], score[score >= threshold], strict=True) if ids[a] != ids[b]]
        i, j, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "score": pa.array(s, pa.float64())})

    large = dealt.groupBy("band", "key", *by, "lo", "hi").applyInArrow(meet, "i long, j long, score double")
    return out.unionByName(large).distinct()


def scored(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(i, j, score) with the agreement of the two signatures."""
    left = signatures.select(F.col("id").alias("i"), F.col("sig").alias("si"))
    right = signatures.select(F.col("id").alias("j"), F.col("sig").alias("sj"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", agreement(F.col("si"), F.col("sj")).alias("score"))


def jaccard_pairs(docs: DataFrame, id_column: str, text_column: str, threshold: float, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(i, j, jaccard) of all pairs i < j of classes whose exact shingle Jaccard reaches threshold, and (id, head): each document's class.

    A class is what documents of one set of shingles are; its head is the first of them.

    Only a prefix of each document's shingles, the rarest first, is joined: two sets that similar share one of their
    size - ceil(threshold * size) + 1 rarest. So frequent shingles are joined last or not at all. What follows the
    shared shingle in the shorter rest bounds the overlap (places of the same order), which drops most other pairs before their sets are looked up.
    Shingles are computed once and staged, a set a row; documents of equal sets are one point until the end.
    """
    hashed = F.array_sort(F.transform(T.shingles_of(T.words(F.col(text_column)), k), lambda x: F.xxhash64(x)))
    every = staged(docs.select(F.col(id_column).alias("id"), hashed.alias("set")).where(F.size("set") > 0), "sets")
    heads = staged(every.groupBy("set").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "heads")
    rows = heads.select("id", F.size("set").alias("n"), F.explode("set").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("df"))
    by_id = Window.partitionBy("id")
    ranked = rows.join(common.where("df > 1"), "s", "left").select("id", "s", "n", F.row_number().over(by_id.orderBy(F.coalesce("df", F.lit(1)), "s")).alias("r"), F.col("df").isNotNull().alias("shared"))
    prefix = staged(ranked.where(F.col("shared") & (F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)).select("id", "s", "n", "r"), "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = x.join(y, "s").where(f"x.id < y.id and x.n >= {threshold} * y.n - 1e-9 and y.n >= {threshold} * x.n - 1e-9")
    pairs = near.groupBy(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.n").alias("xn"), F.col("y.n").alias("yn")).agg(F.count("*").alias("c"), F.max("x.r").alias("xr"), F.max("y.r").alias("yr"))
    bound = F.col("c") + F.least(F.col("xn") - F.col("xr"), F.col("yn") - F.col("yr"))  # nothing is shared in between
    pairs = pairs.where(bound >= (F.col("xn") + F.col("yn")) * (threshold / (1 + threshold)) - 1e-9).select("i", "j")
    sets = heads.select("id", "set")
    both = pairs.join(sets.select(F.col("id").alias("i"), F.col("set").alias("si")), "i").join(sets.select(F.col("id").alias("j"), F.col("set").alias("sj")), "j")
    shared = F.size(F.array_intersect("si", "sj"))
    out = both.select("i", "j", shared.alias("shared"), (F.size("si") + F.size("sj") - shared).alias("total"))
    out = out.select("i", "j", (F.col("shared") / F.col("total")).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return out, every.join(heads.select("set", F.col("id").alias("head")), "set").select("id", "head")
