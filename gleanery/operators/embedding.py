"""Document vectors through an injected encoder, mean pooling, and the contract of batch encoding jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class TooLong(Exception):
    """What an encoder raises for a text beyond its limit."""


def mean_pooled(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vec): the mean of unit vectors, at length 1 again; built-ins only."""
    each = vectors.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    means = each.groupBy(by, "d").agg(F.avg("x").alias("m")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("p"))
    mean = F.transform("p", lambda s: s["m"])
    norm = F.greatest(F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    return means.select(by, F.transform(mean, lambda x: x / norm).alias("vec"))


def embedded(docs: DataFrame, id_column: str, text_column: str, make_encoder: Callable[[], Encoder], size: int = 180, most: int = 24, batch: int = 256, skip_blank: bool = False) -> DataFrame:
    """(id, vec): each text's chunks encoded, averaged and brought to length 1. The encoder is made once in each task.

    At most `most` chunks of a text are read, as the reference's own encoder does. skip_blank: as the remote arm has it, chunks without words
    aren't encoded, and a text of none has a vector of zeros.
    """
    cut = docs.select(F.col(id_column).alias("id"), T.chunks(text_column, size, most).alias("chunks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, width = make_encoder(), 1
        for pdf in frames:
            kept = [[c for c in cs if c.strip() or not skip_blank] for cs in pdf["chunks"]]
            flat = [c for cs in kept for c in cs]
            rows = np.concatenate([_unit(np.asarray(encoder.encode(flat[i : i + batch]), float)) for i in range(0, len(flat), batch)]) if flat else np.zeros((0, width))
            width = max(width, rows.shape[1])
            ends = np.cumsum([len(c) for c in kept])
            yield pd.DataFrame({"id": pdf["id"], "vec": [_unit(rows[a:b].mean(axis=0)[None])[0] if b > a else np.zeros(width) for a, b in zip([0, *ends[:-1]], ends, strict=True)]})

    return cut.mapInPandas(run, "id long, vec array<double>")


def embedded_whole(docs: DataFrame, id_column: str, text_column: str, make_call: Callable[[], Callable[[str], np.ndarray]], tokens: int = 8000) -> DataFrame:
    """(id, vec): each text in one call of a remote encoder, as much of it as the encoder takes, at length 1; a blank text is one space."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_call()
        for pdf in frames:
            vectors = [encode_within(t.strip(), call, tokens) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "vec": [_unit(np.asarray(v, float)[None])[0] for v in vectors]})

    return rows.mapInPandas(run, "id long, vec array<double>")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


# Characters a token, the least text that is tried, how often a text is cut and a call repeated, the longest wait.
TOKEN_CHARS, LEAST_CHARS, CUTS, CALLS, LONGEST_WAIT = 4, 64, 24, 6, 20.0


def beginnings(text: str, tokens: int) -> Iterator[str]:
    """What is sent of a text: as much as the tokens allow, then half of that and so on, each at least LEAST_CHARS."""
    for k in range(CUTS + 1):
        yield (text or " ")[: max(LEAST_CHARS, tokens * TOKEN_CHARS >> k)]


def encode_within(text: str, call: Callable[[str], np.ndarray], tokens: int = 8000, sleep: Callable[[float], None] = time.sleep) -> np.ndarray:
    """A remote encoder's vector of the longest beginning that it takes. Calls that fail otherwise are repeated, CALLS of them in all."""
    waits = iter([min(LONGEST_WAIT, 2.0**k) for k in range(1, CALLS)])
    refused: Exception | None = None
    for part in beginnings(text, tokens):
        vector = None
        while vector is None:
            try:
                vector = call(part)
            except TooLong as e:
                refused = e
                break
            except Exception:
                wait = next(waits, None)
                if wait is None:
                    raise
                sleep(wait)
        if vector is not None:
            return vector
    raise refused or TooLong(text[:LEAST_CHARS])


def batch_input(docs: DataFrame, id_column: str, text_column: str, dimensions: int = 1024) -> DataFrame:
    """(value,): one JSON line for each text of a batch encoding job."""
    model = F.struct(F.col(text_column).alias("inputText"), F.lit(dimensions).alias("dimensions"), F.lit(True).alias("normalize"))
    return docs.select(F.to_json(F.struct(F.col(id_column).cast("string").alias("recordId"), model.alias("modelInput"))).alias("value"))


def batch_output(lines: DataFrame, expected: DataFrame, id_column: str) -> DataFrame:
    """(id, vec) of a job's output lines, matched by id and never by place; fails if an expected id has no vector."""
    row = F.from_json("value", "recordId string, modelOutput struct<embedding: array<double>>")
    got = lines.select(row.alias("r")).select(F.col("r.recordId").alias("record"), F.col("r.modelOutput.embedding").alias("vec")).where("record is not null and vec is not null")
    want = expected.select(F.col(id_column).alias("id"), F.col(id_column).cast("string").alias("record"))
    checked = F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector for "), "record"))).otherwise(F.col("vec"))
    return want.join(got, "record", "left").select("id", checked.alias("vec"))
