"""Arrow access to text columns, and blocks of documents that ask shards of a hash space for counts.

Two operators here need, for each of billions of substrings, to know whether it also stands elsewhere. They share one
plan. Documents are packed into blocks of a few MB (one row each, compressed). A block *asks*: for each shard of the hash
space it sends one row holding all of its keys there, already reduced within the block. A shard *answers* each block with
a few bits a key, in the block's own order, and the block, rebuilt from the input, reads them off. So a key that a third
of all documents share costs one entry a block and not one a document; no shard holds more than one entry a block and key;
and what travels back is bits. The blocks are written once, as a table bucketed by the scan task that made them, so that they never move
again and their numbers hold whatever is lost or run twice: only questions and answers are shuffled.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import shared_dir

# Workers live through many stages: what one of them needed at most goes back to the system at once, not when the worker ends.
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):  # where there is a GNU C library: arrays of over 4 MB are mapped singly
    ctypes.CDLL(None).mallopt(-3, 4 << 20)

#: Stands for a null id inside arrays; it sorts after every id.
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 1 << 20
#: Text that a bucket of blocks holds, about, and the most buckets (Spark's own limit is 100,000).
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 50_000
BLOCK_SCHEMA = "slot long, block long, ids binary, lens binary, data binary"
ASK_SCHEMA = "shard long, slot long, block long, data binary"
REPLY_SCHEMA = "slot long, block long, kind int, shard long, data binary"


def utf8_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes one after another, and each row's start (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), int(NO_ID)), dtype=np.int64)


def ids_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


#: Made once a worker: a context takes longer to make than a short text to compress.
_SQUEEZER, _EXPANDER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _SQUEEZER.compress(data)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, kind, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * np.dtype(kind).itemsize).reshape(-1, n).T).view(kind).ravel()


def expand(data: bytes, limit: int = 1 << 31) -> bytes:
    return _EXPANDER.decompress(data, max_output_size=limit)


def even_slots(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n buckets a number that Spark's hash puts there."""
    each = spark.range(24 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("b")).agg(F.min("id").alias("id")).collect()
    out = np.arange(n)
    for r in each:
        out[r.b] = r.id
    return out


def blocks_of(docs: DataFrame, id_column: str, text_column: str, total: int, prepare: Callable[[bytes], bytes] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as stored blocks of about block_bytes, bucketed by slot. total: bytes of text, which sets the number of buckets.

    prepare turns one text's bytes into what the block holds of it. One text is never split, so a block holds at least
    one document and at most block_bytes besides its last. A scan task's blocks have one slot and so lie in one file.
    """
    spark = docs.sparkSession
    n = max(1, min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))
    slots = even_slots(spark, n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def row():
            nonlocal number, ids, parts, size
            lens = np.array([len(x) for x in parts], np.int64)
            numbers = [[int(slots[part % n])], [(part << 33) + number]]
            out = [[np.array(ids, np.int64).tobytes()], [lens.tobytes()], [squeeze(b"".join(parts))]]
            number, ids, parts, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(x, pa.binary()) for x in out)], names=["slot", "block", "ids", "lens", "data"])

        for batch in batches:
            data, at = utf8_of(batch.column(1))
            raw, at = data.tobytes(), at.tolist()
            for i, doc in enumerate(ids_of(batch.column(0)).tolist()):
                text = raw[at[i] : at[i + 1]]
                parts.append(prepare(text) if prepare else text)
                ids.append(doc)
                size += len(parts[-1])
                if size >= block_bytes:
                    yield row()
        if ids:
            yield row()

    two = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    name = f"blocks_{uuid.uuid4().hex}"
    two.mapInArrow(pack, BLOCK_SCHEMA).write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, "slot").saveAsTable(name)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # rows dealt by slot are dealt by (slot, block) too
    return spark.table(name)


class Block:
    """One unpacked row of BLOCK_SCHEMA: ids and, for each document, its bytes data[at[i]:at[i + 1]]."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(lens, np.int64))])
        self.raw = expand(data)
        self.data = np.frombuffer(self.raw, np.uint8)


def ask_first(blocks: DataFrame, ask: Callable[[Block], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Each block's questions, one row for each shard that it has any for."""

    def run(batches):
        for batch in batches:
            for slot, block, *parts in zip(*(batch.column(i) for i in range(5)), strict=True):
                rows = [(s, slot.as_py(), block.as_py(), d) for s, d in ask(Block(*(x.as_py() for x in parts)))]
                yield asked(rows)

    return blocks.mapInArrow(run, ASK_SCHEMA)


def _rows(rows: list[tuple], names, kinds) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def asked(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return _rows(rows, ("shard", "slot", "block", "data"), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))


def with_replies(blocks: DataFrame, replies: DataFrame, use: Callable[[Block, tuple[int, int], dict], pa.Table], schema: str) -> DataFrame:
    """use(block, (slot, number), replies by (kind, shard)) for every block, those without replies included."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {(k, s): d for k, s, d in zip(right["kind"].to_pylist(), right["shard"].to_pylist(), right["data"].to_pylist(), strict=True)}
        out = [use(Block(a, b, c), (m, n), got) for m, n, a, b, c in zip(*(left[x].to_pylist() for x in ("slot", "block", "ids", "lens", "data")), strict=True)]
        return pa.concat_tables(out)

    return blocks.groupBy("slot", "block").cogroup(replies.groupBy("slot", "block")).applyInArrow(run, schema)


def answered(asks: DataFrame, answer: Callable[[list[bytes]], list[bytes]], kind: int, tasks: int | None = None) -> DataFrame:
    """answer(all blocks' questions of a shard) gives a reply to each, in order; tasks, if given, holds whatever the questions' size."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        out = answer(rows["data"].to_pylist())
        n = len(out)
        return pa.table({"slot": rows["slot"], "block": rows["block"], "kind": pa.array([kind] * n, pa.int32()), "shard": rows["shard"], "data": pa.array(out, pa.binary())})

    return (asks.repartition(tasks, "shard") if tasks else asks).groupBy("shard").applyInArrow(run, REPLY_SCHEMA)


def shard_bits(total: int, per_shard: int) -> int:
    """Bits of a power of two of shards such that each holds about per_shard of the total."""
    return max(0, int(np.ceil(np.log2(max(1, total) / per_shard)))) if total > per_shard else 0


def text_bytes(docs: DataFrame, text_column: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string"))).alias("n")).first()["n"] or 0


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n at least; base is odd, so it has an inverse."""
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        step[0] = 1
        got = _POWERS[base, inverse] = np.cumprod(step, dtype=np.uint64)
    return got[:n]


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """Sums of (byte + 1) * base ** place, so that any span's hash is a difference times a power's inverse."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    h = (sums[end] - sums[start]) * powers(base, len(sums), inverse=True)[start]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def counts_before(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place, and in all; a block holds fewer than 2 ** 31."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def covered_from(starts: np.ndarray, width: int) -> np.ndarray:
    """For flags of window starts, whether each place lies within any flagged window of that width."""
    sums = counts_before(starts)
    out = sums[1:] > 0
    np.not_equal(sums[width:], sums[:-width], out=out[width - 1 :])
    return out


def joined_spreading(rows: DataFrame, named: DataFrame, key: str, counts: str = "n", how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined with named (inner or left), where no key's rows meet in one task however many there are.

    named has one row a key, with the number of its rows in `counts` (dropped), and is staged. Keys with over one in `share` of all those rows, of
    which there are fewer than `share`, are broadcast; the others are joined as the optimiser likes, for which the rows of broadcast
    keys, already served, get keys of their own.
    """
    total = named.agg(F.sum(counts)).first()[0] or 0
    is_hot = F.col(counts) * share > total
    values = [c for c in named.columns if c not in (key, counts)]
    side = lambda df, mark: df.select(F.col(key).alias(f"__{mark}"), F.struct(*values).alias(f"__{mark}_values"))
    hot, cold = side(named.where(is_hot), "hot"), side(named.where(~is_hot), "cold")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__own", F.xxhash64(*rows.columns))
    served = F.col("__hot").isNotNull()
    cold = cold.withColumns({"__no": F.lit(0).cast("long"), "__cold_key": F.col("__cold")})
    marked = marked.withColumns({"__number": F.when(served, F.col("__own")).otherwise(0), "__key": F.when(~served, F.col(key))})
    met = marked.join(cold, (F.col("__key").eqNullSafe(F.col("__cold_key"))) & (F.col("__number") == F.col("__no")), "left")
    if how == "inner":
        met = met.where("__hot is not null or __cold is not null")
    found = F.coalesce("__hot_values", "__cold_values")
    return met.select(*rows.columns, *(found[v].alias(v) for v in values))


_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majorities(h: np.ndarray, starts: np.ndarray, words: int = 1) -> np.ndarray:
    """For each run h[starts[i]:starts[i + 1]] (the last one to the end, none empty), 64 * words bits that over half of its hashes have.

    The first 64 are the hashes' own, further ones those of hashes derived from them. Eight bits are counted in the eight
    bytes of one number, over at most 255 hashes at a time.
    """
    sizes = np.diff(np.append(starts, len(h)))
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    out = np.empty((len(starts), words), np.uint64)
    for w in range(words):
        each = np.ascontiguousarray(mixed(h + np.uint64(w)) if w else h).view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(starts), 8), np.uint8)
        for b in range(8):
            lanes = np.add.reduceat(_LANES[each[:, b]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts = np.add.reduceat(lanes, first, axis=0)
            bits[:, b] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")[:, 0]
        out[:, w] = bits.view(np.uint64)[:, 0]
    return out
