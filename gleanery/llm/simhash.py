"""SimHash near-duplicates, compared through tables of distances to reference fingerprints (pivots).

Each distinct fingerprint is linked once. A pigeonhole deals them out: two fingerprints that differ in at most `distance`
bits agree in at least `blocks - distance` of `blocks` runs of bits, so every choice of that many runs makes one table, and
linked fingerprints meet under an equal key in at least one. Within a bucket each fingerprint has its row of a pivot table:
the Hamming distances to PIVOTS reference fingerprints. By the triangle inequality those rows differ by at most the distance
of the two fingerprints in every coordinate, so a pair with a larger difference in any is discarded, and survivors are
verified on the bits. A large bucket isn't expanded into pairs: it is walked, each member compared with what isn't reached
yet, which yields a spanning forest of its links.

Defined results: a null or empty text has fingerprint 0, linked like any other. A component's id is the smallest non-null
doc_id in it (null if it has none). Repeated rows each come out. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.operators.components import connected_components
from gleanery.session import dropped, staged

PIVOTS = 16
#: Buckets up to this size are compared pair by pair, larger ones walked.
SMALL = 48
#: Buckets of over this size are dealt again by further bits.
LARGE = 4096
#: Texts whose rows leave Python together.
ROWS_OUT = 256
FP_SCHEMA = "doc_id long, fp long"


def pivots(n: int = PIVOTS, words: int = 1) -> np.ndarray:
    """The reference fingerprints of `words` times 64 bits: the first values of a splitmix64 sequence."""
    return C.mixed(np.arange(1, n * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, words)


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `width` words, or of the whole sequence where it is shorter; none for no words."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    xx = xxhash.xxh64_intdigest
    return np.array([xx(line[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(texts: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text over the XXH64 of all shingles of `width` words; a bit is 1 if set in over half of them."""
    hashes = [shingle_hashes(x.lower().split(), width, seed) for x in texts]
    out = np.zeros(len(texts), np.uint64)
    some = [i for i, h in enumerate(hashes) if len(h)]
    if some:
        sizes = np.array([len(hashes[i]) for i in some])
        out[some] = C.majorities(np.concatenate([hashes[i] for i in some]), np.cumsum(sizes) - sizes)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the whole text's fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                data, at = C.utf8_of(batch.column(1))
                raw, at = data.tobytes(), at.tolist()
                out = fingerprint_of([raw[a:b] for a, b in zip(at, at[1:], strict=False)], width, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, FP_SCHEMA)


def runs_of_bits(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each run; together they are the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _pairs(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs stand: the pivot tables' largest coordinate difference first, then the bits."""
    near = np.ones(len(i), bool)
    for p in range(table.shape[1]):
        k = np.flatnonzero(near)
        near[k] = np.abs(table[i[k], p] - table[j[k], p]) <= distance
    k = np.flatnonzero(near)
    near[k] = np.bitwise_count(fp[i[k]] ^ fp[j[k]]).sum(axis=1, dtype=np.int64) <= distance
    return near


def _walk(fp: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all that is linked in a bucket: each member reached is compared with those not reached yet."""
    links, rest = [], np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            hit = _pairs(fp, table, np.full(len(rest), a), rest, distance)
            links += [(a, b) for b in rest[hit].tolist()]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return links


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key whose fingerprints (n rows of 64-bit words) are near, as two arrays of places."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((*fp.T, key))
    key, fp = key[order], fp[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(cuts, len(key)))
    shared = np.repeat(sizes > 1, sizes)
    table = np.zeros((len(key), PIVOTS), np.int16)
    for p, pivot in enumerate(pivots(words=fp.shape[1])):
        table[shared, p] = np.bitwise_count(fp[shared] ^ pivot).sum(axis=1, dtype=np.int16)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = (sizes > 1) & (sizes <= SMALL)
    for step in range(1, SMALL):  # all pairs `step` apart, over all small buckets at once
        has = small & (sizes > step)
        if not has.any():
            break
        n = sizes[has] - step
        i = np.repeat(cuts[has] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        i = i[_pairs(fp, table, i, i + step, distance)]
        a.append(i)
        b.append(i + step)
    for at, n in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        links = np.array(_walk(fp[at : at + n], table[at : at + n], distance), np.int64).reshape(-1, 2)
        a.append(at + links[:, 0])
        b.append(at + links[:, 1])
    return order[np.concatenate(a)], order[np.concatenate(b)]


def finer_keys(fp: np.ndarray, key: np.ndarray, runs: list[tuple[int, int]], distance: int) -> np.ndarray:
    """For fingerprints that agree outside `runs`, a key for each choice of two of distance + 2 pieces of the bits there (rows: choices)."""
    dense, bits = np.zeros(len(fp), np.uint64), 0
    for shift, width in runs:
        dense = dense << np.uint64(width) | fp >> np.uint64(shift) & np.uint64((1 << width) - 1)
        bits += width
    cuts = [bits * i // (distance + 2) for i in range(distance + 3)]
    pieces = [dense >> np.uint64(a) & np.uint64((1 << b - a) - 1) for a, b in itertools.pairwise(cuts)]
    choices = itertools.combinations(range(distance + 2), 2)
    return np.stack([C.mixed(C.mixed(key + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (pieces[i] << np.uint64(32) | pieces[j])) for k, (i, j) in enumerate(choices)])


def fingerprint_links(distinct: DataFrame, distance: int = 4, blocks: int | None = None, rows_a_task: int = 400_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most `distance` bits.

    With blocks = distance + 2, keys have about 21 bits in 15 tables, enough for some 10 million fingerprints at a few in a
    bucket; each further block adds bits (distance + 3: 27 bits, 35 tables) and is taken as the count grows. Buckets of over
    LARGE fingerprints are dealt again by the bits that their key leaves out, a pigeonhole of the same kind, before anything is compared.
    """
    n = distinct.count()
    blocks = blocks or distance + (2 if n < 20_000_000 else 3 if n < 2_000_000_000 else 4)
    all_runs = runs_of_bits(blocks)
    tables = list(itertools.combinations(all_runs, blocks - distance))

    def key(number: int, runs) -> F.Column:
        out = F.lit(number).cast("long")
        for shift, width in runs:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = F.shiftleft(out, width).bitwiseOR(part)
        return F.struct(F.lit(number).alias("number"), out.alias("key"))

    dealt = distinct.select("fp", F.explode(F.array(*(key(k, runs) for k, runs in enumerate(tables)))).alias("k")).select("fp", "k.number", "k.key")
    crowded = staged(dealt.groupBy("number", "key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("number", "key"), "crowded")
    many = crowded.count()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, number, keys = (np.asarray(batch.column(k)) for k in range(3))
            for t in np.unique(number).tolist():
                own = number == t
                left = [x for x in all_runs if x not in tables[t]]
                for row in finer_keys(fp[own].view(np.uint64), C.mixed(keys[own].view(np.uint64) + np.uint64(t)), left, distance):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(row.view(np.int64))], names=["fp", "key"])

    out = dealt.select("fp", "key")
    if many:
        finer = dealt.join(crowded, ["number", "key"], "left_semi").select("fp", "number", "key").mapInArrow(again, "fp long, key long")
        out = dealt.join(crowded, ["number", "key"], "left_anti").select("fp", "key").unionByName(finer)
    parts = max(12, -(-n * len(tables) // rows_a_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
        if cols:
            fp, keys = (np.concatenate(x) for x in zip(*cols, strict=True))
            a, b = bucket_links(keys, fp.view(np.uint64)[:, None], distance)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return out.repartition(parts, "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    prints = staged(fingerprints(docs, id_column, text_column, width, seed), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    links = fingerprint_links(distinct.select("fp"), distance)
    found = connected_components(links, "a", "b")
    linked = staged(distinct.join(found, distinct["fp"] == found["node"]).select("fp", "least", "n", F.col("component").alias("root")), "linked")
    heads = staged(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "heads")
    of_linked = C.joined_spreading(linked, heads, "root", "members").select("fp", "component_id", "n")
    alone = distinct.join(found, distinct["fp"] == found["node"], "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    named = staged(of_linked.unionByName(alone), "named")
    return C.joined_spreading(prints, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by similarity: what differs in a fifth of its shingles has fingerprints too far apart for a pigeonhole on 64 bits.

WORDS = 2
#: Candidates agree in all ROWS least hashes of one of BANDS: 0.9996 of the pairs of similarity 0.8 do, and more of nearer ones.
BANDS, ROWS = 20, 5
NAMES = [f"w{i}" for i in range(WORDS)]
WIDE_SCHEMA = "doc_id long, sha binary, node long, shingles array<int>, keys array<long>, " + ", ".join(f"{x} long" for x in NAMES)
#: Bytes of text that are hashed together.
TEXT_BYTES = 1 << 19
#: Sets smaller than this have too few shingles for the deviations of their fingerprints to be known.
FEW = 64
#: Shingles in a block of the nodes of large buckets.
BLOCK_SHINGLES = 2_000_000
BASE = 0xA0761D6478BD642F
_FACTORS = C.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words (lower case, ASCII white space between) as sorted 64-bit hashes."""
    words = [x.lower().split() for x in texts]
    line = b" ".join([b" ".join(w) for w in words if w])
    n = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    each = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    first = np.cumsum(n) - n
    at = np.concatenate([[0], np.cumsum(each)])
    from_word = np.repeat(first - at[:-1], each) + np.arange(at[-1])
    to_word = np.minimum(from_word + width, np.repeat(first + n, each)) - 1
    hashes = C.span_hash(C.prefix_hash(data, BASE), start[from_word], end[to_word], BASE) if at[-1] else np.zeros(0, np.uint64)
    return [np.unique(hashes[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def band_keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of h, BANDS keys made of ROWS least values each (of the hashes times a factor)."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for f in _FACTORS[b * ROWS : (b + 1) * ROWS]:
            key = C.mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * f, starts))
        out[:, b] = key
    return out


def distance_at(similarity: float, deviations: float, bits: int = 64 * WORDS) -> int:
    """The expected number of differing bits between two sets of equal size and that Jaccard similarity, and some deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def _lists(each: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(each)))


def _bucket_candidates(key: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float, loose: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, d) of rows of buckets up to SMALL that may be similar, by sizes and fingerprints d bits apart.

    Sets that may meet one under FEW are compared without their fingerprints.
    """
    out = [np.zeros((3, 0), np.int64)]
    wide = np.flatnonzero(n >= FEW)
    a, b = (wide[x] for x in bucket_links(key[wide], fp[wide], loose))
    out.append(np.stack([a, b, np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64)]))
    few = np.flatnonzero(n * similarity < FEW)
    a, b = (few[x] for x in bucket_links(key[few], np.zeros_like(fp[few]), 0))
    short = (n[a] < FEW) | (n[b] < FEW)
    out.append(np.stack([a[short], b[short], np.full(int(short.sum()), 64 * WORDS, np.int64)]))
    a, b, d = np.concatenate(out, axis=1)
    near = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
    return a[near], b[near], d[near]


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose two nodes' sets of shingles are similar indeed."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    sized = links.select("a", "b").join(left, "a").join(right, "b").where(small >= large * similarity - 1e-9)
    return sized.where(both >= (F.size("x") + F.size("y") - both) * similarity - 1e-9).select("a", "b")


def _rooted(links: DataFrame, links_of_roots: DataFrame) -> DataFrame:
    """links with the roots (ra, rb) of their ends renewed by links between roots; those within one root go."""
    found = staged(connected_components(links_of_roots, "ra", "rb"), "renewed")
    for side in ("ra", "rb"):
        one = found.select(F.col("node").alias(side), F.col("component").alias("to"))
        links = links.join(one, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return links.where("ra <> rb").select("a", "b", "d", "ra", "rb")


def _true_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """From links (a, b, d), d bits apart, true ones that join all that the true ones join, by the sets of shingles.

    First the nearest of each node are verified, and after joining by what held, all that still lead from one root to another.
    """
    links = links.withColumns({"ra": F.col("a"), "rb": F.col("b")})
    nearest = F.min(F.struct("d", "a", "b", "ra", "rb")).alias("e")
    picked = links.groupBy("ra").agg(nearest).select("e.*").unionByName(links.groupBy("rb").agg(nearest).select("e.*")).distinct()
    picked = staged(picked.select("a", "b", "d", "ra", "rb"), "picked")
    held = staged(_verified(picked, sets, similarity), "held")
    rest = links.join(picked.select("a", "b"), ["a", "b"], "left_anti")
    rest = staged(_rooted(rest, picked.join(held, ["a", "b"]).select("ra", "rb")), "rest")
    return held.unionByName(_verified(rest, sets, similarity))


def block_links(node: np.ndarray, root: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], similarity: float, loose: int) -> list[tuple[int, int]]:
    """Links that join all nodes that true links join; nodes of one root count as joined. Each is verified before a node is left out."""
    n = np.array([len(x) for x in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(int(codes.max(initial=0)) + 1, bool)
    links, rest = [], np.arange(len(node))
    while len(rest):
        queue = rest[root[rest] == root[rest[0]]].tolist()
        rest = rest[root[rest] != root[rest[0]]]
        while queue and len(rest):
            a = queue.pop()
            near = np.minimum(n[a], n[rest]) >= similarity * np.maximum(n[a], n[rest]) - 1e-9
            far = np.bitwise_count(fp[rest] ^ fp[a]).sum(axis=1, dtype=np.int64) > loose
            some = rest[near & ((n[a] < FEW) | (n[rest] < FEW) | ~far) & (n[rest] > 0)]
            if not len(some):
                continue
            ends = np.cumsum(n[some])
            marked[codes[at[a] : at[a + 1]]] = True
            both = np.add.reduceat(marked[codes[np.repeat(at[some] - ends + n[some], n[some]) + np.arange(ends[-1])]], ends - n[some], dtype=np.int64)
            marked[codes[at[a] : at[a + 1]]] = False
            held = some[both >= (n[a] + n[some] - both) * similarity - 1e-9]
            links += [(int(node[a]), int(node[b])) for b in held]
            more = np.isin(root[rest], root[held])
            queue += rest[more].tolist()
            rest = rest[~more]
    return links


def _settled(found: DataFrame, met: DataFrame, sets: DataFrame, similarity: float, loose: int) -> DataFrame:
    """Further links, found and verified among the nodes of large buckets that aren't all of one root.

    Nodes that share such buckets form a cluster; it is dealt in blocks of about BLOCK_SHINGLES shingles and each two blocks meet in a
    task, so that no bucket's size bounds what is found, nor a task's work grows with it.
    """
    roots = found.select(F.col("node").alias("at"), "component")
    large = met.where(F.col("many") > SMALL).select("key", "node")
    large = large.join(roots, F.col("node") == F.col("at"), "left").select("key", "node", F.coalesce("component", "node").alias("root"))
    open_keys = large.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("node").alias("head")).where("least <> most").select("key", "head")
    large = staged(large.join(open_keys, "key").select("head", "node", "root").distinct(), "large")
    cluster = connected_components(large, "head", "node").toDF("at", "cluster")
    members = large.select("node", "root").distinct().join(cluster, F.col("node") == F.col("at")).select("node", "root", "cluster")
    members = staged(members.join(sets, "node"), "members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES).cast("long").alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("blocks", F.greatest("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("block", "other", "blocks")

    def run(rows: pa.Table) -> pa.Table:
        node, root = np.asarray(rows["node"]), np.asarray(rows["root"])
        fp = np.stack([np.asarray(rows[f"w{i}"]) for i in range(WORDS)], axis=1).view(np.uint64)
        sets = [np.asarray(x.values) for x in rows["shingles"]]
        got = np.array(block_links(node, root, fp, sets, similarity, loose), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long")


def _prints(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """WIDE_SCHEMA: each document's node (one for each set of shingles), set, keys and fingerprint."""

    def rows(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        some = [i for i, x in enumerate(sets) if len(x)]
        prints, keys = np.zeros((len(texts), WORDS), np.uint64), [np.zeros(0, np.uint64)] * len(texts)
        if some:
            h, sizes = np.concatenate([sets[i] for i in some]), np.array([len(sets[i]) for i in some])
            starts = np.cumsum(sizes) - sizes
            prints[some] = C.majorities(h, starts, WORDS)
            for i, k in zip(some, band_keys(h, starts), strict=True):
                keys[i] = k
        node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
        cols = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (node, *prints.T)]
        sha = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
        short = _lists([np.unique(x.astype(np.uint32)).view(np.int32) for x in sets])
        return pa.RecordBatch.from_arrays([ids, sha, cols[0], short, _lists([x.view(np.int64) for x in keys]), *cols[1:]], names=[x.split()[0] for x in WIDE_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.utf8_of(batch.column(1))
            raw, lo = data.tobytes(), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, min(lo + ROWS_OUT, int(np.searchsorted(at, at[lo] + TEXT_BYTES, side="right")) - 1))
                yield rows(batch.column(0).slice(lo, hi - lo), [raw[a:b] for a, b in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist(), strict=True)])
                lo = hi

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, WIDE_SCHEMA)


def _met(nodes: DataFrame) -> DataFrame:
    """(key, node, many, pivot): the nodes of every key that several have, how many do, and the one with most copies."""
    dealt = nodes.select(F.explode("keys").alias("key"), "node", "copies")
    pivot = F.max_by("node", F.struct("copies", "node")).alias("pivot")
    shared = dealt.groupBy("key").agg(F.count("*").alias("many"), pivot).where("many > 1")
    return dealt.join(shared, "key").select("key", "node", "many", "pivot")


def _grouped(prints: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of all nodes that are linked to another."""
    known = nodes.select("node", F.col("count").alias("n"), *NAMES)
    loose = distance_at(similarity, 6)
    met = staged(_met(nodes), "met")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            rows = pa.Table.from_batches(got)
            fp = np.stack([np.asarray(rows[c]) for c in NAMES], axis=1).view(np.uint64)
            key, node, n = (np.asarray(rows[c]) for c in ("key", "node", "n"))
            a, b, d = _bucket_candidates(key, n, fp, similarity, loose)
            out = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), d]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "d"])

    told = met.where(F.col("many") <= SMALL).select("key", "node").join(known, "node")
    pairs = told.repartition(max(12, -(-met.count() // 50_000)), "key").mapInArrow(link, "a long, b long, d long")
    # members of larger buckets first meet their bucket's pivot alone
    star = met.where((F.col("many") > SMALL) & (F.col("node") != F.col("pivot"))).select("node", "pivot").distinct()
    other = known.select(F.col("node").alias("pivot"), F.col("n").alias("m"), *(F.col(x).alias(f"p{x}") for x in NAMES))
    star = star.join(known, "node").join(other, "pivot")
    bits = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"p{x}"))) for x in NAMES), F.lit(0))
    few = (F.col("n") < FEW) | (F.col("m") < FEW)
    star = star.withColumn("d", F.when(few, 64 * WORDS).otherwise(bits).cast("long")).where(few | (F.col("d") <= loose)).where(F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9)
    links = staged(pairs.unionByName(star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "d")).distinct(), "links")
    # written, so that its measured size decides whether all sets must be shuffled, once, to find these
    ends = staged(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).unionByName(met.where(F.col("many") > SMALL).select("node")).distinct(), "ends")
    sets = staged(prints.select("node", "shingles", *NAMES).join(ends, "node", "left_semi").dropDuplicates(["node"]), "sets")
    true = staged(_true_links(links, sets, similarity), "true")
    dropped(links, ends)
    found = connected_components(true, "a", "b")
    if not met.where(F.col("many") > SMALL).isEmpty():
        found = connected_components(staged(true.unionByName(_settled(found, met, sets, similarity, loose)), "true"), "a", "b")
    found = staged(found.toDF("node", "root"), "roots")
    dropped(met, sets)
    return found


def _read(docs: DataFrame, id_column: str, text_column: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """prints; nodes; (node, root) of the linked ones; (root, head, members): the first document of each group of linked nodes."""
    prints = staged(_prints(docs, id_column, text_column, width), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("first")
    keys = [F.first(x).alias(x) for x in (*NAMES, "keys")]
    nodes = staged(prints.groupBy("node").agg(first, F.count("*").alias("copies"), F.first(F.size("shingles").cast("long")).alias("count"), *keys), "nodes")
    found = _grouped(prints, nodes, similarity)
    heads = staged(nodes.select("node", "first").join(found, "node").groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("members")), "heads")
    return prints, nodes, found, heads


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, sha, component_id, keep): groups linked by `similarity` of their shingles; keep marks one text of each.

    sha is the text's SHA-256 (null: empty). Candidates agree in a band of their shingles' least hashes; fingerprints of the shingles,
    compared through pivot tables, then estimate the similarity: six deviations beyond the limit discards (but never sets under
    FEW), and each other link is verified on the sets of shingles (32 bits of each hash): pairs of small buckets in joins, large ones
    with their pivot and then by _settled(). Kept is the smallest doc_id (nulls last, then by sha).
    """
    prints, nodes, found, heads = _read(docs, id_column, text_column, width, similarity)
    linked = C.joined_spreading(found, heads, "root", "members").select("node", "head").join(nodes.select("node", "copies"), "node")
    alone = nodes.join(found, "node", "left_anti").select("node", F.col("first").alias("head"), "copies")
    named = staged(linked.unionByName(alone), "named")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("sha") == F.col("head.sha"))
    return C.joined_spreading(prints, named, "node", "copies").select("doc_id", "sha", F.col("head.doc_id").alias("component_id"), same.alias("keep"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one for each group of near copies, all columns as they were.

    A null or empty text is a copy of each other one without words. Of rows equal in id and text the least one stays, by the JSON of
    their columns.
    """
    prints, nodes, found, heads = _read(docs, id_column, text_column, width, similarity)
    chosen = heads.select("head").unionByName(nodes.join(found, "node", "left_anti").select(F.col("first").alias("head")))
    each = prints.groupBy("doc_id", "sha").agg(F.count("*").alias("__n")).where("__n > 1")
    chosen = chosen.select(F.col("head.doc_id").alias("__kept_id"), F.col("head.sha").alias("__kept_sha"))
    twice = (each["doc_id"].eqNullSafe(chosen["__kept_id"])) & (each["sha"] == chosen["__kept_sha"])
    kept = staged(chosen.join(each, twice, "left").select("__kept_id", "__kept_sha", F.coalesce("__n", F.lit(1)).alias("__n")), "kept")
    dropped(prints, nodes, found, heads)
    marked = docs.withColumn("__own_sha", F.unhex(F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary"), 256)))

    def chosen_of(some: DataFrame) -> DataFrame:
        on = marked[id_column].cast("long").eqNullSafe(some["__kept_id"]) & (marked["__own_sha"] == some["__kept_sha"])
        return marked.join(some, on, "left_semi")

    # only rows that repeat an id and a text need a second look
    once, repeated = chosen_of(kept.where("__n = 1")).drop("__own_sha"), kept.where("__n > 1")
    if not repeated.isEmpty():
        row = F.struct(*(F.col(c) for c in docs.columns))
        least = chosen_of(repeated).groupBy(F.col(id_column).alias("__i"), "__own_sha").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
        once = once.unionByName(least)
    return once
