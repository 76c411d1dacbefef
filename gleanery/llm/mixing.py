"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Targets: the sources, by code point with null last, weigh `weights` in turn and share `share` times all words; a target stops
at `most` times its source's size and the excess is shared again by weight. The documents of a source are dealt into shards of
about WORDS_A_SHARD words by a seeded hash of their ids and texts. In a shard, each source's documents in seeded order are one run of
words, cut into blocks of an equal number of words. Sainte-Laguë gives the shard's blocks to its sources one by one by highest
quotient (target / (2 * given + 1)), none beyond `most` times the blocks that it has; the integer quota of a source then takes
each of its blocks quota // blocks times and the rest of the quota from blocks in a seeded order. So a word is taken at most
`most` times, all that is decided depends on ids, texts and the seed, and a shard's work is bounded at any size of source.

The block's size is BLOCK_WORDS whatever the sources. A source whose target has fewer than LEAST_BLOCKS blocks, where whole ones would be
too coarse, is settled to the word: of the last block in its seeded order only the first words are taken.

Defined results: null and empty texts have size 0 and nothing is taken of them. Rows are dealt by id and text.
Repeated rows are documents of their own. A source of size 0 has target 0. Extra columns are ignored (or kept, see mixed()).
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import common as C
from gleanery.session import staged

WORDS_A_SHARD = 1_000_000
BLOCK_WORDS, LEAST_BLOCKS = 256, 200
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from rows (source, size). Ordered steps run over one row a source, not over documents."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = by.select("source", "source_size", rank.alias("rank")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double"))
    full = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({"all": share * F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    full = full.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "taken_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # in order of cap / weight, a source is stopped at its cap if the rate that the rest would get reaches its ratio
    full = full.withColumn("stops", (F.col("all") - F.col("caps")) / (F.col("all_weight") - F.col("taken_weight")) >= F.col("ratio"))
    stopped = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(0.0)).over(everything)
    full = full.withColumn("rate", F.try_divide(F.col("all") - stopped("cap"), F.col("all_weight") - stopped("weight")))
    return full.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("rate") * F.col("weight")).alias("target"))


def apportion(targets: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotient target / (2 * given + 1), none above most; ties go to the smaller index.

    Starts from what every divisor method gives anyway (the floor of each fair share) and gives the rest one by one.
    """
    seats = int(min(seats, most.sum()))
    total = targets.sum()
    if not seats or not total:
        return np.zeros(len(targets), np.int64)
    rate = total / seats
    given = np.minimum(np.maximum(0, np.floor(targets / rate - 0.5)).astype(np.int64), most)
    while given.sum() > seats:  # the quotient that came last goes first
        given[int(np.argmin(np.where(given > 0, targets / np.maximum(1, 2 * given - 1), np.inf)))] -= 1
    heap = [(-t / (2 * g + 1), i) for i, (t, g, m) in enumerate(zip(targets.tolist(), given.tolist(), most.tolist(), strict=True)) if t > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-targets[i] / (2 * int(given[i]) + 1), i))
    return given


def _times(n_blocks: int, quota: int, seed: list[int]) -> np.ndarray:
    """How often each block is taken."""
    times = np.full(n_blocks, quota // n_blocks, np.int64)
    times[np.random.default_rng(seed).permutation(n_blocks)[: quota % n_blocks]] += 1
    return times


def _times_to_the_word(total: int, block: int, words: int, seed: list[int]) -> tuple[list[int], list[int]]:
    """Where runs of words start, and how often each is taken, for `words` words in all: whole blocks and the start of one."""
    n = -(-total // block)
    times = np.full(n, words // total, np.int64)
    rest, part = words % total, None
    for b in np.random.default_rng(seed).permutation(n).tolist():
        own = min(total, (b + 1) * block) - b * block
        if rest < own:
            part = (b, rest) if rest else None
            break
        times[b] += 1
        rest -= own
    starts, often = [b * block for b in range(n)], times.tolist()
    if part:
        starts.insert(part[0] + 1, part[0] * block + part[1])
        often.insert(part[0], often[part[0]] + 1)
    return starts, often


def mix_shard(rows: pa.Table, block: int, most: int, seed: int) -> list[list[tuple[int, int, int]]]:
    """For one shard's rows (source, order, id, size, source_size, target), each row's runs of words taken: (start, end, times)."""
    out: list[list] = [[] for _ in range(len(rows))]
    names = [(x is None, x or "") for x in rows["source"].to_pylist()]
    ranks = {x: i for i, x in enumerate(sorted(set(names)))}
    rank = np.array([ranks[x] for x in names], np.int64)
    ids, sizes = C.ids_of(rows["id"]), np.asarray(rows["size"])
    order = np.lexsort((sizes, ids, np.asarray(rows["order"]), rank))
    cuts = np.searchsorted(rank[order], np.arange(len(ranks) + 1))
    spans = []
    for name, lo, hi in zip(ranks, cuts.tolist(), cuts[1:].tolist(), strict=False):
        at = order[lo:hi]
        if total := int(sizes[at].sum()):
            i = int(at[0])
            spans.append((name, at, float(rows["target"][i].as_py()) * total / rows["source_size"][i].as_py(), -(-total // block)))
    if not spans:
        return out
    targets, blocks = np.array([x[2] for x in spans]), np.array([x[3] for x in spans])
    quotas = apportion(targets, most * blocks, round(float(targets.sum()) / block))
    shard = rows["shard"][0].as_py()
    for (name, at, target, n), quota in zip(spans, quotas.tolist(), strict=True):
        own_seed = [seed, shard, int(name[0]), zlib.crc32(name[1].encode())]
        starts = np.concatenate([[0], np.cumsum(sizes[at])]).tolist()
        if float(rows["target"][int(at[0])].as_py()) < LEAST_BLOCKS * block:
            cuts_at, times = _times_to_the_word(starts[-1], block, min(round(target), most * starts[-1]), own_seed)
        else:
            cuts_at, times = [b * block for b in range(n)], _times(n, quota, own_seed).tolist()
        ends = [*cuts_at[1:], starts[-1]]
        for row, lo, hi in zip(at.tolist(), starts, starts[1:], strict=False):
            b = bisect.bisect_right(cuts_at, lo) - 1
            while lo < hi and b < len(ends) and cuts_at[b] < hi:
                if times[b]:
                    out[row].append((max(lo, cuts_at[b]) - lo, min(hi, ends[b]) - lo, times[b]))
                b += 1
    return out


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken and spans: the runs of words taken, each with its times."""
    dealt = _dealt(docs, weights, share, most, seed, id_column, text_column, source_column, ())
    spans = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "end", "times")]))
    schema = T.StructType([*dealt.schema.fields, T.StructField("taken", T.LongType()), T.StructField("spans", spans)])

    def run(rows: pa.Table) -> pa.Table:
        got = mix_shard(rows, BLOCK_WORDS, most, seed)
        taken = pa.array([sum((b - a) * t for a, b, t in x) for x in got], pa.int64())
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "times")]))
        return rows.append_column("taken", taken).append_column("spans", pa.array([[dict(zip(("start", "end", "times"), y, strict=True)) for y in x] for x in got], kind))

    out = dealt.groupBy("shard").applyInArrow(run, schema)
    return out.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "taken", "spans")


def _dealt(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int, id_column: str, text_column: str, source_column: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows with their size, target and shard (and columns to keep, by place)."""
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.xxhash64(F.col(id_column).cast("long"), F.col(text_column).cast("string"))  # rows that share an id, or have none, are dealt by their texts
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(source_column).cast("string").alias("source"), size.alias("size"), own.alias("own"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    targets = staged(source_targets(rows.select("source", "size"), weights, share, most), "targets")  # one row a source
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-total // WORDS_A_SHARD))
    known = rows.join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    order = F.xxhash64(F.lit(seed), "own")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "own"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / WORDS_A_SHARD)))
    dealt = known.withColumns({"order": order, "shard": F.pmod(F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(shards)) + part, F.lit(shards))})
    return dealt.drop("own")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def taken_text(text: bytes, spans: list[tuple[int, int, int]], copy: int) -> bytes:
    """What copy number `copy` (from 1) takes of a text: runs of words as they stand there, what is cut out a line end."""
    runs: list[list[int]] = []
    for a, b, times in spans:
        if times >= copy and b > a:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
    if not runs:
        return b""
    words = [m.span() for m in _WORD.finditer(text)]
    if runs == [[0, len(words)]]:
        return text
    return b"\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", length_column: str = "n_chars") -> DataFrame:
    """The mix as rows of docs' columns: a row for each copy that takes any of a document, its text cut to the words taken."""
    columns = docs.columns
    dealt = _dealt(docs, weights, share, most, seed, id_column, text_column, source_column, tuple(columns))
    place = columns.index(text_column)
    length = columns.index(length_column) if length_column in columns else -1

    def run(rows: pa.Table) -> pa.Table:
        spans = mix_shard(rows, BLOCK_WORDS, most, seed)
        own = rows.select([f"kept_{i}" for i in range(len(columns))]).rename_columns(columns)
        out = []
        for copy in range(1, most + 1):
            has = [i for i, x in enumerate(spans) if any(t >= copy for _, _, t in x)]
            texts = (own[text_column][i].as_py() for i in has)
            got = [taken_text(t.encode(), spans[i], copy) for i, t in zip(has, texts, strict=True)]
            part = own.drop_columns([text_column]).take(pa.array(has, pa.int64())).add_column(place, own.schema.field(place), pa.array(got, pa.binary()).cast(own.schema.field(place).type))
            if length >= 0:
                kind = own.schema.field(length)
                part = part.set_column(length, kind, pa.array([len(x.decode()) for x in got], pa.int64()).cast(kind.type))
            out.append(part)
        return pa.concat_tables(out)

    return dealt.groupBy("shard").applyInArrow(run, docs.schema)
