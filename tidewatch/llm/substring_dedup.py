"""Repeated passages by fixed-block anchors.

A window of `window` words that occurs twice holds, wherever it stands, a whole block of
`window // 2` words that starts at a multiple of `window // 2` of its document.  So:

1. Index the non-overlapping blocks of every document, and probe them with every rolling
   window of that size.  Hashes travel to their bucket as packed arrays, each once per batch of
   documents however often the batch holds it; a hit is a hash that was probed twice and is a
   block somewhere.  Hits go back to their batch and become runs of positions per document.
2. Only windows of `window` words that hold a hit are hashed whole: one hash deals them into
   buckets, another of 64 bits tells them apart there.  They travel packed, too, each once per
   batch.  Of equal windows all but the first by (doc_id, start) are repeats.
3. Repeats that overlap or touch are one maximal span; its words go.

Contract of `drop_repeats`: returns every row and column of docs with `n_words`, `n_removed`,
`spans` (start and end word of each removed span) and `kept_text` (the kept words, joined by
one space), which replace columns of those names.  A null or empty text has no words.  Rows
of one doc_id and one text are one document: their windows stand at the same place, so
neither removes the other's.  A row without doc_id is left whole and removes nothing.  An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, blocks, bounded_batches, extended, join_hashes, partitions, query, rolling, set_aside, table

WINDOW = 20
BATCH = 8 << 20  # bytes of text within which equal probes and windows travel once
_ALIGNED, _TWICE = 64, 128  # flags in the high byte of a packed gap


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which k consecutive words of one text start.  first: of each text, and the end."""
    n = np.diff(first)
    ok = np.zeros(first[-1], bool)
    for a, m in zip(first[:-1][n >= k].tolist(), n[n >= k].tolist()):
        ok[a : a + m - k + 1] = True
    return np.flatnonzero(ok)


def pack(tags: np.ndarray, at: np.ndarray, flags: np.ndarray | int = 0) -> bytes:
    """Tags, ascending positions and flags, in byte planes: the high ones compress well."""
    gaps = np.diff(at, prepend=0).astype(np.uint32)
    high = gaps >> np.uint32(8)
    wide = int(len(high) > 0 and high.max() >= _ALIGNED)
    flags = np.broadcast_to(np.uint8(flags), gaps.shape)
    planes = [np.uint8([wide]), tags.view(np.uint8), (gaps & np.uint32(255)).astype(np.uint8)]
    if wide:
        planes += [(gaps >> np.uint32(s)).astype(np.uint8) for s in (8, 16, 24)] + [flags]
    else:
        planes.append(high.astype(np.uint8) | flags)
    return b"".join(p.tobytes() for p in planes)


def unpack(raw: bytes, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, width = np.frombuffer(raw, np.uint8), np.dtype(kind).itemsize if kind else 0
    n = (len(a) - 1) // (width + (5 if a[0] else 2))
    tags, rest = a[1 : 1 + width * n].copy().view(kind or "u1"), a[1 + width * n :].reshape(-1, n)
    if a[0]:
        gaps, flags = sum(rest[i].astype(np.int64) << (8 * i) for i in range(4)), rest[4]
    else:
        gaps, flags = rest[0].astype(np.int64) | ((rest[1] & 63).astype(np.int64) << 8), rest[1] & 192
    return tags, np.cumsum(gaps), flags


def join_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, behind their lengths."""
    sizes = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], "<i8")
    return sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def split_arrays(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds), 8).tolist(), 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def runs(at: np.ndarray) -> np.ndarray:
    """Ascending positions as rows (first, last) of consecutive ones."""
    if not len(at):
        return np.zeros((0, 2), np.int32)
    breaks = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]], axis=1).astype(np.int32)


def probes(docs: DataFrame, block: int, n_buckets: int) -> DataFrame:
    """(bucket, batch, payload): packed probes, and for bucket -1 the documents of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for got in batches:
            for part, texts in blocks(got, most=BATCH):
                words = Words(texts)
                n = np.diff(words.first)
                at = inside(words.first, block)
                at = at[np.repeat(n >= 2 * block, n)[at]]  # a shorter text has no window
                if not len(at):
                    continue
                h = rolling(words.hashes(), block)[at]
                unique, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                flags = np.where(counts > 1, _TWICE, 0).astype(np.uint8)
                starts = words.first[:-1][words.owner()[at]]
                flags[inverse[(at - starts) % block == 0]] |= _ALIGNED
                again = np.ones(len(h), bool)
                again[first] = False
                ids = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key")])
                copies = np.stack([at[again], at[first][inverse[again]]]).astype("<u4")
                side = join_arrays(ids.astype("<i8"), words.first.astype("<i8"), copies)
                bucket = ((unique >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
                where = at[first]
                order = np.lexsort((where, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                payload = [side]
                filled = np.flatnonzero(np.diff(cuts))
                tags = (unique & np.uint64(2**32 - 1)).astype(np.uint32)
                for b in filled.tolist():
                    own = order[cuts[b] : cuts[b + 1]]
                    payload.append(pack(tags[own], where[own], flags[own]))
                yield _dealt(np.r_[-1, filled], number, payload)
                number += 1

    return docs.mapInArrow(run, DEALT)


DEALT, FOUND = "bucket int, batch long, payload binary", "batch long, kind int, payload binary"


def _dealt(buckets: np.ndarray, number: int, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(buckets.astype(np.int32)), pa.array(np.full(len(payload), number, np.int64)), pa.array(payload, pa.binary()),
    ], names=["bucket", "batch", "payload"])


def _found(batch: list[int], kind: int, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(batch, pa.int64()), pa.array([kind] * len(batch), pa.int32()), pa.array(payload, pa.binary())],
        names=["batch", "kind", "payload"],
    )


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one key after the other, from input sorted by it."""
    held, last = [], None
    for got in batches:
        for row in got.to_pylist():
            if held and row[key] != last:
                yield held
                held = []
            held.append(row)
            last = row[key]
    if held:
        yield held


def by_bucket(packed: DataFrame, meet: Callable[[list[bytes]], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(batch, kind, payload): word positions that a bucket's rows find in a batch (kind 1).

    meet: from the payloads of a bucket to (number of the payload, ascending positions).
    Rows of bucket -1, the documents of a batch, come through as they are (kind 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "bucket"):
            if group[0]["bucket"] < 0:
                yield _found([r["batch"] for r in group], 0, [r["payload"] for r in group])
                continue
            for i, at in meet([r["payload"] for r in group]):
                yield _found([group[i]["batch"]], 1, [pack(np.zeros(0, np.uint8), at)])

    n = partitions(packed.sparkSession)
    dealt = packed.repartition(n, "bucket", F.when(F.col("bucket") < 0, F.col("batch")))
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def by_batch(found: DataFrame, close: Callable[[bytes, list[np.ndarray]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What close makes of a batch's documents and of the positions found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "batch"):
            got = close(group[0]["payload"], [unpack(r["payload"], "")[1] for r in group[1:]])
            if got is not None:
                yield got

    n = partitions(found.sparkSession)
    return found.repartition(n, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, schema)


def hits(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Probes whose hash was probed twice and is a block somewhere."""
    parts = [unpack(p) for p in payloads]
    tags, at, flags = (np.concatenate(x) for x in zip(*parts))
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(tags, kind="stable")
    begins = np.flatnonzero(np.r_[True, tags[order][1:] != tags[order][:-1]])
    size = np.diff(np.r_[begins, len(order)])
    seen = np.bitwise_or.reduceat(flags[order], begins)
    hit = ((size > 1) | (seen & _TWICE > 0)) & (seen & _ALIGNED > 0)
    yield from _per_owner(np.sort(order[np.repeat(hit, size)]), owner, at, len(parts))


def _per_owner(found: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.searchsorted(owner[found], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, at[found[cuts[i] : cuts[i + 1]]]


def _rows(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
    """Word positions of a batch as packed runs per document."""
    cuts = np.searchsorted(at, first)
    some = np.flatnonzero(np.diff(cuts))
    if not len(some):
        return None
    return pa.RecordBatch.from_arrays([
        pa.array(ids[0][some]), pa.array(ids[1][some]),
        pa.array([runs(at[cuts[i] : cuts[i + 1]] - first[i]).tobytes() for i in some.tolist()], pa.binary()),
    ], names=["doc_id", "text_key", "runs"])


RUNS = "doc_id long, text_key long, runs binary"


def candidates(packed: DataFrame, block: int) -> DataFrame:
    """(doc_id, text_key, runs): window starts of a document that hold a hit."""

    def close(side: bytes, found: list[np.ndarray]) -> pa.RecordBatch | None:
        ids, first, copies = split_arrays(side, "<i8", "<i8", "<u4")
        ids, copies = ids.reshape(2, -1), copies.reshape(2, -1)
        hit = np.zeros(first[-1] + 1, np.int32)
        for at in found:
            hit[at] = 1
        hit[copies[0]] = hit[copies[1]]
        total = np.r_[0, np.cumsum(hit)]
        windows = inside(first, 2 * block)
        return _rows(ids, first, windows[total[windows + block + 1] > total[windows]])

    return by_batch(by_bucket(packed, hits), close, RUNS)


def _expand(raw: bytes) -> np.ndarray:
    got = np.frombuffer(raw, np.int32).reshape(-1, 2)
    return np.concatenate([np.arange(a, b + 1) for a, b in got.tolist()]) if len(got) else np.zeros(0, np.int64)


def windows_of(texts: DataFrame, block: int, n_buckets: int) -> DataFrame:
    """(bucket, batch, payload): packed candidate windows, and for bucket -1 the documents.

    texts: doc_id, text_key, text, runs.  A batch sends each window once, from its first place
    there; that the others come later, or stand at the same place, is known already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for got in batches:
            got = got.filter(pa.compute.is_valid(got.column("runs")))
            for part, texts in blocks(got, most=BATCH):
                words = Words(texts)
                local = [_expand(r) for r in part.column("runs").to_pylist()]
                row = np.repeat(np.arange(len(texts)), [len(x) for x in local])
                start = np.concatenate(local)
                at = start + words.first[row]
                sides = []
                for seed in (0, 1):
                    half = rolling(words.hashes(seed), block)
                    sides.append(join_hashes(half[at], half[at + block]))
                ids = np.stack([part.column(c).to_numpy() for c in ("doc_id", "text_key")])
                order = np.lexsort((start, ids[0][row], sides[1], sides[0]))
                a, b, row, at, start = (x[order] for x in (*sides, row, at, start))
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                late = (ids[0][row] != ids[0][row[lead]]) | (start != start[lead])
                same = ~new & ~late
                side = join_arrays(
                    ids.astype("<i8"), words.first.astype("<i8"), np.sort(at[late]).astype("<u4"),
                    np.stack([at[same], at[lead][same]]).astype("<u4"),
                )
                a, b, row, at = a[new], b[new], row[new], at[new]
                bucket = ((b >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((at, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                filled = np.flatnonzero(np.diff(cuts))
                payload = [side]
                for i in filled.tolist():
                    own = order[cuts[i] : cuts[i + 1]]
                    docs, n = np.unique(row[own], return_counts=True)
                    places = ids[0][docs].astype("<i8"), words.first[docs].astype("<u4"), n.astype("<u4")
                    payload.append(join_arrays(*places, np.frombuffer(pack(a[own], at[own]), np.uint8)))
                yield _dealt(np.r_[-1, filled], number, payload)
                number += 1

    return texts.mapInArrow(run, DEALT)


def later(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Windows that also start earlier, by (doc_id, start)."""
    parts = []
    for p in payloads:
        ids, first, n, packed = split_arrays(p, "<i8", "<u4", "<u4", "u1")
        tags, at, _ = unpack(packed.tobytes(), "<u8")
        parts.append((tags, at, np.repeat(ids, n), at - np.repeat(first, n)))
    tags, at, ids, start = (np.concatenate(x) for x in zip(*parts))
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((start, ids, tags))
    new = np.r_[True, tags[order][1:] != tags[order][:-1]]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = order[(ids[order] != ids[lead]) | (start[order] != start[lead])]
    yield from _per_owner(np.sort(late), owner, at, len(parts))


def repeated(packed: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs): starts of the windows that also start earlier."""

    def close(side: bytes, found: list[np.ndarray]) -> pa.RecordBatch | None:
        ids, first, late, copies = split_arrays(side, "<i8", "<i8", "<u4", "<u4")
        mark = np.zeros(first[-1] + 1, bool)
        for at in found:
            mark[at] = True
        copies = copies.reshape(2, -1)
        mark[copies[0]] = mark[copies[1]]
        mark[late] = True
        return _rows(ids.reshape(2, -1), first, np.flatnonzero(mark))

    return by_batch(by_bucket(packed, later), close, RUNS)


@set_aside("text_key", "runs")
def drop_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    block = window // 2
    docs = docs.drop("n_words", "n_removed", "spans", "kept_text")
    keyed = docs.withColumn("text_key", F.xxhash64(F.col(text)))
    own = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", F.col(text).alias("text"))
    n_buckets = 4 * partitions(docs.sparkSession)

    def once(found: DataFrame) -> DataFrame:  # repeated rows find the same
        return found.groupBy("doc_id", "text_key").agg(F.first("runs").alias("runs"))

    # Both joins deal out the same columns by the same key, so Spark shuffles the texts once.
    near = once(candidates(probes(own, block, n_buckets), block))
    texts = keyed.join(near, ["doc_id", "text_key"], "left").select("doc_id", "text_key", F.col(text).alias("text"), "runs")
    found = once(repeated(windows_of(texts, block, n_buckets)))
    marked = keyed.join(found, ["doc_id", "text_key"], "left")
    columns = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for part, texts in blocks(got, text):
                words = Words(texts)
                n_words = np.diff(words.first)
                removed, spans, kept = [], [], []
                for i, (starts, n) in enumerate(zip(part.column("runs").to_pylist(), n_words.tolist())):
                    gone = np.zeros(n + 1, np.int32)
                    if starts:
                        starts = _expand(starts)
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, starts + window, -1)
                    gone = np.cumsum(gone)[:n] > 0
                    removed.append(int(gone.sum()))
                    spans.append([[a, b + 1] for a, b in runs(np.flatnonzero(gone)).tolist()])
                    stay = np.flatnonzero(~gone) + words.first[i]
                    ends = words.ends[stay].tolist()
                    kept.append(" ".join([words.bytes[a:b].decode() for a, b in zip(words.starts[stay].tolist(), ends)]))
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in columns], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string()),
                ], names=[*columns, "n_words", "n_removed", "spans", "kept_text"])

    schema = extended(
        marked.select(*columns).schema, n_words="long", n_removed="long", spans="array<array<int>>", kept_text="string"
    )
    return marked.select(*dict.fromkeys([*columns, text]), "runs").mapInArrow(run, schema)


@query("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bounded_batches(spark, 4 * BATCH)
    return drop_repeats(docs, keep_text=False).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
