"""Byte-level BPE: texts to ids by overlapping chunks, ids to bytes.

Contract of `encode`: returns every row and column of docs, with `ids` (binary: the ids as
little-endian unsigned 32-bit integers, the form that training shards are stored in) and
`n_tokens`.  Columns of those names are replaced.  A null or empty text has no ids and 0
tokens; repeated rows are encoded each on their own; an empty table gives an empty table.
docs must be a table or a deterministic frame: long rows are numbered as they are written.

A text of up to `chunk` characters is one chunk.  A longer one becomes chunks that overlap.
Each chunk is pre-tokenised by itself, wherever it lands.  Pre-tokenising has no memory, so
two chunks that share one boundary agree from there on: the text is cut at the first boundary
that both have, away from the left chunk's end, where its last match may still be incomplete.
If an overlap has no such boundary, the two chunks are joined.  The pieces are encoded in
parallel and their ids put together in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks, extended, map_texts, materialise, partitions, query, table

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK, OVERLAP = 1 << 15, 1 << 10

_LOADED: dict[tuple, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, loaded once per worker."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def _ids(enc: tiktoken.Encoding, text: str) -> bytes:
    return np.asarray(enc.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes() if text else b""


def starts_of(pattern: regex.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.start() for m in pattern.finditer(text)), np.int32)


def cut_between(left: str, left_starts: np.ndarray, right_starts: np.ndarray, step: int) -> int | None:
    """Where to pass from a chunk to the next one, which begins `step` characters later.

    Only before white space that follows another character: no match of the pattern can
    span that place, whatever Unicode version classifies the characters around it.
    """
    shared = np.intersect1d(left_starts, right_starts + step, assume_unique=True)
    for b in shared.tolist():
        if step < b < len(left) - 1 and left[b].isspace() and not left[b - 1].isspace():
            return b
    return None


def stitch(chunks: list[tuple[int, str, bytes]], step: int) -> Iterator[str]:
    """Pieces of a text from its chunks in order: (number, text, match starts)."""
    text, starts, begin = None, None, 0
    for number, (_, nxt, raw) in enumerate(chunks):
        nxt_starts = np.frombuffer(raw, "<i4")
        if text is None:
            text, starts, offset = nxt, nxt_starts, 0
            continue
        gap = number * step - offset
        at = cut_between(text, starts, nxt_starts, gap)
        if at is None:  # no shared boundary: go on with both as one chunk
            keep = starts[starts < gap]
            text, starts = text[:gap] + nxt, np.concatenate([keep, nxt_starts + gap])
            continue
        yield text[begin:at]
        begin = at - gap
        text, starts, offset = nxt, nxt_starts, number * step
    if text is not None and begin < len(text):
        yield text[begin:]


def encode(
    docs: DataFrame, ranks: str = MULTI, pattern: str = public_tokenizers.PATTERN, text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and shorter than a chunk")
    docs = docs.drop("ids", "n_tokens")
    step = chunk - overlap
    long = F.coalesce(F.char_length(text), F.lit(0)) > chunk

    def whole(texts: list[str]) -> dict[str, pa.Array]:
        enc = encoding(ranks, pattern)
        return {"ids": pa.array([_ids(enc, t) for t in texts], pa.binary())}

    short_rows = map_texts(docs.where(~long), whole, text, ids="binary")

    rows = materialise(docs.where(long).withColumn("__row", F.monotonically_increasing_id()), "long_texts")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                for row, t in zip(part.column("__row").to_pylist(), texts):
                    cuts = range(0, max(1, len(t) - overlap), step)
                    yield pa.RecordBatch.from_pydict({
                        "__row": pa.array([row] * len(cuts), pa.int64()),
                        "number": pa.array(range(len(cuts)), pa.int32()),
                        "piece": pa.array([t[c : c + chunk] for c in cuts], pa.string()),
                    })

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            for part, texts in blocks(batch, "piece"):
                yield part.append_column("starts", pa.array([starts_of(compiled, t).astype("<i4").tobytes() for t in texts], pa.binary()))

    def stitched(group: pa.Table) -> pa.Table:
        got = sorted(zip(group["number"].to_pylist(), group["piece"].to_pylist(), group["starts"].to_pylist()))
        pieces = list(stitch(got, step))
        return pa.table({
            "__row": pa.array([group["__row"][0].as_py()] * len(pieces), pa.int64()),
            "number": pa.array(range(len(pieces)), pa.int32()),
            "piece": pa.array(pieces, pa.string()),
        })

    def joined(group: pa.Table) -> pa.Table:
        got = sorted(zip(group["number"].to_pylist(), group["ids"].to_pylist()))
        return pa.table({"__row": group["__row"][:1], "ids": pa.array([b"".join(x for _, x in got)], pa.binary())})

    n = partitions(docs.sparkSession)
    cut = rows.select("__row", text).mapInArrow(chunks, "__row long, number int, piece string")
    known = cut.repartition(n, "__row", "number").mapInArrow(boundaries, "__row long, number int, piece string, starts binary")
    pieces = known.groupBy("__row").applyInArrow(stitched, "__row long, number int, piece string")
    coded = map_texts(pieces.repartition(n, "__row", "number"), whole, "piece", ids="binary").drop("piece")
    ids = coded.groupBy("__row").applyInArrow(joined, "__row long, ids binary")
    long_rows = rows.join(ids, "__row", "left").drop("__row")
    return short_rows.unionByName(long_rows).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(coded: DataFrame, ranks: str = MULTI, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """Every row and column of coded, with `decoded`: the bytes of its ids (null ids: none)."""
    schema = extended(coded.schema, decoded="binary")
    keep = [f.name for f in schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            out = [enc.decode_bytes(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(out, pa.binary())], names=keep + ["decoded"])

    return coded.mapInArrow(run, schema)


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
