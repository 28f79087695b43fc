"""Quality by compression: which of two dictionaries, from good or from bad text, helps more.

A bounded sample of labelled documents (`PER_CLASS` of each label, `PIECES` pieces of `PIECE`
bytes of each, chosen by hash) gives two zstandard dictionaries from one half of it.  A text
is compressed piece by piece without a dictionary and with each of the two; the difference of
the two sizes, normalised by the plain size, says which text it is like.  A logistic function
of that difference, of its extremes over the pieces, and of the plain compression ratio,
fitted on the other half, gives the score.  Whole texts are scored, however long.

Contract of `score`: returns every row and column of docs with `score` (0 to 1, higher: label
1 is likelier), which replaces a column of that name.  A null or empty text has sizes of
zero and so the score of a text of which nothing is known; repeated rows are scored each;
an empty table gives an empty table.  Without rows of both labels the score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks, fold, map_texts, query, table
from .labelled import fit_logistic, labels_of, sample_ids

PER_CLASS, PIECES, PIECE = 2000, 6, 1024
DICTIONARY, LEVEL = 1 << 16, 3
PREDICT = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]


def pieces_of(text: str, size: int = PIECE) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of samples too few to train on, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


class Sizes:
    """Compressed sizes of pieces without and with each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False}
        self.by = [zstandard.ZstdCompressor(**plain)] + [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad)
        ]

    def features(self, text: str) -> list[float]:
        pieces = pieces_of(text)
        if not pieces:
            return [0.0] * 6
        sizes = np.array([[len(c.compress(p)) for c in self.by] for p in pieces], float)
        n = sum(map(len, pieces))
        none, good, bad = sizes.sum(axis=0)
        each = (sizes[:, 2] - sizes[:, 1]) / sizes[:, 0]
        ratio = sizes[:, 0] / [len(p) for p in pieces]
        return [10 * (bad - good) / none, 10 * each.min(), 10 * each.max(), 4 * none / n, 4 * ratio.min(), np.log(n) / 10]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """labels: doc_id and label, of the rows to learn from."""
    chosen = sample_ids(labels_of(labels, label), per_class)  # at most 2 * per_class rows, so it may be broadcast
    rows = docs.where("doc_id is not null").select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                took = [sorted(pieces_of(t), key=xxhash.xxh3_64_intdigest)[:PIECES] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(took, pa.list_(pa.binary()))], names=["doc_id", "label", "pieces"]
                )

    learn = rows.where("part = 0").select("doc_id", "label", "text").mapInArrow(cut, "doc_id long, label int, pieces array<binary>")
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for row in learn.orderBy("doc_id", "label").collect():
        samples[row.label] += map(bytes, row.pieces)
    good, bad = dictionary(samples[1]), dictionary(samples[0])

    def measured(texts: list[str]) -> dict[str, pa.Array]:
        own = Sizes(good, bad)
        return {"features": pa.array([own.features(t) for t in texts], pa.list_(pa.float64()))}

    fitted = map_texts(rows.where("part = 1").select("doc_id", "label", "text"), measured, features="array<double>").drop("text")
    got = fitted.orderBy("doc_id").collect()
    y = np.array([r.label for r in got], float)
    if not len(y) or y.min() == y.max():
        share = (chosen.agg(F.avg("label")).first()[0] if not len(y) else y.mean()) or 0.0
        share = min(max(share if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(good, bad, [0.0] * 6 + [float(np.log(share / (1 - share)))])
    return Model(good, bad, fit_logistic(np.array([r.features for r in got]), y, ridge=0.1).tolist())


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    def scored(texts: list[str]) -> dict[str, pa.Array]:
        own = Sizes(model.good, model.bad)
        x = np.array([own.features(t) for t in texts]).reshape(-1, 6)
        z = x @ model.weights[:-1] + model.weights[-1]
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())}

    return map_texts(docs, scored, text, score="double")


@query("op1_quality")
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = score(docs, fit(docs, labels, "quality"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted")
    )
