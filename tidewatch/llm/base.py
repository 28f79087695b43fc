"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise, shared_dir

__all__ = ["materialise", "shared_dir"]

SPACES = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches by bytes as well as by rows: texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by modulus; a null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extended(schema: T.StructType, **extra: str) -> T.StructType:
    """The schema with columns added at the end; a clashing column is replaced."""
    taken = {k.lower() for k in extra}
    fields = [f for f in schema.fields if f.name.lower() not in taken]
    return T.StructType(fields + [T.StructType.fromDDL(f"{k} {v}").fields[0] for k, v in extra.items()])


def set_aside(*names: str):
    """Decorate an operator that uses columns of these names in its work: the caller's columns of
    the same names pass it under other names and come back as they were."""

    def decorate(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(fn)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            own = {n.lower() for n in names}
            away = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in own}
            if not away:
                return fn(docs, *args, **kwargs)
            return fn(docs.withColumnsRenamed(away), *args, **kwargs).withColumnsRenamed({v: k for k, v in away.items()})

        return run

    return decorate


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every depth, as Python workers return it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, nullable(kind.valueType))
    return kind


def map_texts(
    df: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array]], text: str = "text", **extra: str
) -> DataFrame:
    """Add columns that a function makes of the texts (null: empty), batch by batch.

    The function gets at most about 2 MB of text at a time.
    """
    schema = extended(df.schema, **extra)
    keep = [f.name for f in schema.fields if f.name not in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                made = fn(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keep] + [made[k] for k in extra], names=keep + list(extra)
                )

    return df.mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch that hold about `most` bytes of text each, never less than a row."""
    texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


# ---------------------------------------------------------------- words

_WORD_BYTE = bytes(0 if chr(i) in SPACE_CHARS else 1 for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LONG = 64


class Words:
    """The words of many texts, one after the other, without Python strings.

    data: the bytes of all texts; starts, ends: of each word in data;
    first: of each text the index of its first word, and the number of all words at the end.
    """

    def __init__(self, texts: Iterable[str], lower: bool = False):
        raw = [t.encode() for t in texts]
        joined = b"\n".join(raw) + b"\n" + bytes(8)
        if lower:
            joined = joined.translate(_LOWER)
        n = len(joined) - 8
        self.bytes = joined
        self.data = np.frombuffer(joined, np.uint8)
        inside = np.frombuffer(joined[:n].translate(_WORD_BYTE), np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
        self.bounds = bounds
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        starts, size = self.starts, self.ends - self.starts
        words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = mix(size.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        at = np.flatnonzero(size <= _LONG) if len(size) and size.max() > _LONG else slice(None)
        for j in range(0, _LONG, 8):
            left = size[at] - j
            if not (left > 0).any():
                break
            if j:
                keep = left > 0
                at = (np.arange(len(size)) if isinstance(at, slice) else at)[keep]
                left = left[keep]
            chunk = words[starts[at] + j]
            short = np.minimum(left, 8).astype(np.uint64)
            chunk = chunk & (np.uint64(2**64 - 1) >> ((np.uint64(8) - short) * np.uint64(8)))
            h[at] = mix(h[at] ^ chunk)
        for i in np.flatnonzero(size > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.bytes[starts[i] : self.ends[i]], seed)
        return h

    def owner(self) -> np.ndarray:
        """Of each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two halves."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values, by doubling."""
    if len(h) < k:
        return h[:0]
    out, done, power, size = None, 0, h, 1
    while k:
        if k & 1:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - done)
                out = join_hashes(out[:n], power[done : done + n])
            done += size
        k >>= 1
        if k:
            power = join_hashes(power[:-size], power[size:])
            size *= 2
    return out


def agreeing(a: list[int], b: list[int], i: int, j: int, most: int) -> int:
    """How many values agree from a[i] and b[j] on, at most `most`, by exponential probing and halving."""
    done, step = 0, 1
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] != b[j + done : j + done + step]:
            break
        done += step
        step *= 2
    else:
        return done
    while step > 1:  # the first difference lies in this block
        half = step // 2
        if a[i + done : i + done + half] == b[j + done : j + done + half]:
            done += half
            step -= half
        else:
            step = half
    return done


def binary(items: Iterable[bytes]) -> pa.Array:
    return pa.array(list(items), pa.binary())


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{label}"
