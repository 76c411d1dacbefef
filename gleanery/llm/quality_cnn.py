"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are looked up in a learned table of DIMS numbers each; FILTERS learned filters of WIDTH bytes slide over
it STRIDE bytes at a time, in chunks of CHUNK bytes that overlap by WIDTH - STRIDE so that no position is lost between two.
Each chunk keeps every filter's largest response; a document's features are the mean and the maximum of its chunks' responses,
and one logistic unit turns them into a probability. Scoring covers the whole text at any length, a fixed run of chunks at a
time. Training takes the whole texts of at most FIT_ROWS rows of each label, on the driver, and of each a short piece with the same
label, since short texts are few among the rows; the weights (some 20 KB) are sent to the executors.

Defined results: a null or empty text is scored as one chunk of padding. Rows whose label is null, whose document is
missing, or whose id has both labels teach nothing; of several texts of an id the least one teaches; where one label has no rows, every score is the share of the other (0.5 with no rows at all).
Repeated rows and ties need no care: a score depends on the text alone. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common as C

DIMS, WIDTH, STRIDE, FILTERS, CHUNK = 6, 8, 4, 32, 512
FIT_ROWS, STEPS, BATCH = 700, 448, 50
SHORT = (8, 160)
#: Positions convolved at once, a multiple of a chunk's.
STEP = CHUNK // STRIDE
RUN = 512 * STEP
SCHEMA = "doc_id long, score double"


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "table": r.normal(0, 0.5, (257, DIMS)).astype(f),
            "filters": r.normal(0, 1 / np.sqrt(WIDTH * DIMS), (WIDTH * DIMS, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "out": np.zeros(2 * FILTERS, f),
            "level": np.zeros(1, f),
        }
        self.w["table"][256] = 0
        self.flat: float | None = None

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Rows of WIDTH embedded bytes, one each STRIDE bytes; data is padded with 256 to full chunks and a margin."""
        seen = self.w["table"][data]
        n = (len(data) - WIDTH) // STRIDE + 1
        s = seen.strides
        return np.lib.stride_tricks.as_strided(seen, (n, WIDTH * DIMS), (s[0] * STRIDE, s[1]), writeable=False)

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Each chunk's largest response of every filter, not below 0."""
        out = []
        for at in range(0, len(data) - (WIDTH - STRIDE), RUN * STRIDE):
            x = self.windows(data[at : at + RUN * STRIDE + WIDTH - STRIDE])
            out.append((x @ self.w["filters"]).reshape(-1, STEP, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(out) + self.w["bias"], 0)

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text data[at[i]:at[i + 1]], which may be empty."""
        if self.flat is not None:
            return np.full(len(at) - 1, self.flat)
        laid, n = laid_out(data, at)
        pooled = self.chunks(laid)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        mean = np.add.reduceat(pooled, first, axis=0) / n[:, None]
        most = np.maximum.reduceat(pooled, first, axis=0)
        z = (np.concatenate([mean, most], axis=1) @ self.w["out"] + self.w["level"]).astype(np.float64)
        return 1 / (1 + np.exp(-z))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
        """Adam on the logistic loss, both labels weighing the same."""
        if len(set(labels.tolist())) < 2:
            self.flat = float(labels[0]) if len(labels) else 0.5
            return self
        r = np.random.default_rng(seed)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = np.zeros(0, np.int64)
        for t in range(1, STEPS + 1):  # as many steps for few rows as for many
            if not len(order):
                order = r.permutation(len(texts))
            rows, order = order[:BATCH], order[BATCH:]
            rate = 0.01 * 0.8 ** (8 * t // STEPS)
            for k, g in self.gradients([texts[i] for i in rows], labels[rows], weight[rows]).items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        data, n = laid_out(np.frombuffer(b"".join(texts), np.uint8), at)
        args, tops = [], []
        for start in range(0, len(data) - (WIDTH - STRIDE), RUN * STRIDE):
            raw = (self.windows(data[start : start + RUN * STRIDE + WIDTH - STRIDE]) @ self.w["filters"]).reshape(-1, STEP, FILTERS)
            args.append(raw.argmax(axis=1))
            tops.append(np.take_along_axis(raw, args[-1][:, None, :], axis=1)[:, 0])
        arg, top = np.concatenate(args), np.concatenate(tops) + self.w["bias"]
        x = self.windows(data)
        pooled = np.maximum(top, 0)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        mean = np.add.reduceat(pooled, first, axis=0) / n[:, None]
        most = np.maximum.reduceat(pooled, first, axis=0)
        feats = np.concatenate([mean, most], axis=1)
        p = 1 / (1 + np.exp(-(feats @ self.w["out"] + self.w["level"])))
        dz = ((p - y) * weight / len(y)).astype(np.float32)
        df = dz[:, None] * self.w["out"][None, :]
        back = np.repeat(df[:, :FILTERS] / n[:, None], n, axis=0)
        doc = np.repeat(np.arange(len(n)), n)
        peak = pooled == most[doc]
        back = (back + df[doc, FILTERS:] * peak) * (top > 0)
        place = (np.arange(len(arg))[:, None] * STEP + arg).ravel()  # the window that gave each chunk's maximum
        which = np.tile(np.arange(FILTERS), len(arg))
        g = back.ravel()
        some = np.flatnonzero(g)
        place, which, g = place[some], which[some], g[some]
        d_filters = np.zeros_like(self.w["filters"])
        d_table = np.zeros_like(self.w["table"])
        seen = x[place]
        for f in range(FILTERS):
            k = which == f
            d_filters[:, f] = g[k] @ seen[k]
        spread = (g[:, None] * self.w["filters"].T[which]).reshape(-1, WIDTH, DIMS)
        bytes_at = data[place[:, None] * STRIDE + np.arange(WIDTH)]
        for d in range(DIMS):
            d_table[:, d] = np.bincount(bytes_at.ravel(), spread[:, :, d].ravel(), minlength=257)
        d_table[256] = 0
        return {"table": d_table, "filters": d_filters, "bias": back.sum(axis=0), "out": dz @ feats, "level": dz.sum(keepdims=True)}


def laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each padded with 256 to whole chunks, and how many chunks each has (at least one)."""
    sizes = np.diff(at)
    n = np.maximum(1, -(-sizes // CHUNK))
    starts = np.concatenate([[0], np.cumsum(n * CHUNK)])
    out = np.full(starts[-1] + WIDTH - STRIDE, 256, np.int16)
    out[np.arange(len(data)) + np.repeat(starts[:-1] - at[:-1], sizes)] = data
    return out, n


def remainder(id_column: str) -> F.Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4


def trained(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Network:
    """Learns from at most fit_rows rows of each label that aren't held out, chosen by a hash of their ids."""
    known = labels.select(F.col(id_column).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(remainder("i") != 2)
    known = known.groupBy("i").agg(F.max("y").alias("y"), F.min("y").alias("least")).where("y = least").select("i", "y")
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(fit_rows) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    texts = docs.select(F.col(id_column).cast("long").alias("i"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: r.i)
    texts, labels = [r.t.encode() for r in rows], [r.y for r in rows]
    pick = np.random.default_rng(11)
    for text in list(texts):
        n = int(pick.integers(*SHORT))
        at = int(pick.integers(0, max(1, len(text) - n)))
        texts.append(text[at : at + n])
    labels += labels
    return Network().fit(texts, np.array(labels, np.float32))


def scored(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            data, at = C.utf8_of(batch.column(1))
            out, lo = [], 0
            while lo < len(at) - 1:  # about 4 MB of texts at a time
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (4 << 20), side="right")) - 1)
                out.append(net.scores(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], names=["doc_id", "score"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on)."""
    out = scored(docs, trained(docs, labels, id_column, text_column), id_column, text_column)
    return out.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def crc_remainder(i: int) -> int:
    return zlib.crc32(str(i).encode()) % 4


def accepted(docs: DataFrame, network: Network, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows whose text scores the threshold at least, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield part.filter(pa.array(net.scores(*C.utf8_of(part.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
