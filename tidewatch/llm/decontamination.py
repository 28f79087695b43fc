"""Benchmark items inside documents, within an edit budget, by the q-gram lemma.

Texts are compared with A-Z lower-cased and each white-space character as a space.  An item
of m characters that stands in a document with at most k edits shares at least m - q + 1 - kq
of its q-grams with that place, all of them on diagonals (place in the document minus place in
the item) that differ by at most k.  Diagonals are cut into bands of 2k + 1 that overlap by k,
so one band holds them all: bands with that many shared q-grams are kept, all others are
proven clean.  A kept band is verified by banded alignment of the whole item.  Items under
`MIN_CHARS` characters are too short for an edit budget: they are searched exactly, where no
letter or digit goes on at either end, unless `short` is False.

The items are a query set; they go to the workers in blocks of about `BLOCK` bytes, whatever
their number, and each block passes over the documents once.

Contract of `find`: returns every row and column of docs with `matches`, which replaces a
column of that name: item_id, first and end byte of the place, edits; one match per item and
band that aligns within the budget, the best place in it.  A null or empty text has no
matches; repeated rows are searched each; repeated items match each; null and blank items
match nothing.  Long texts, and texts and items that repeat one character, take no more memory
than others.  Without items every array is empty; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACE_CHARS, blocks, extended, query, table

Q, RATE, MIN_CHARS = 8, 0.08, 32
BLOCK = 1 << 20
STRETCH, EVENTS, KNOWN = 1 << 20, 1 << 18, 1 << 14  # what a worker holds at a time; results are the same at any
_BITS = 22
_PLAIN = bytes(32 if chr(i) in SPACE_CHARS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_INSIDE = bytes(int(chr(i).isalnum() or i >= 128) for i in range(256))  # bytes of letters and digits
MATCH = "array<struct<item_id: long, first: int, end: int, edits: int>>"


def plain(text: str) -> bytes:
    return text.encode().translate(_PLAIN)


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an item of m bytes: a share of m that leaves an eighth of its q-grams."""
    return max(0, min(int(rate * m), (m - Q + 1 - m // 8) // Q))


def grams(data: bytes) -> np.ndarray:
    """The 8-byte grams at every place, each as one number."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)).astype(np.uint64)


def _cell(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int32)


@dataclass
class Index:
    """The q-grams of a block of items, sorted, with the items and places each occurs at.

    Places of one q-gram in one item that are no further apart than a step of bands are one
    run: whatever the item repeats, a q-gram has at most m / (k + 1) + 1 runs in it.
    """

    ids: list
    items: list[bytes]

    def __post_init__(self):
        every = [grams(x) for x in self.items]
        all_grams = np.concatenate([*every, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(every)), [len(g) for g in every])
        place = np.concatenate([*(np.arange(len(g)) for g in every), np.zeros(0, int)])
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.k = np.array([budget(len(x)) for x in self.items], np.int64)
        self.least = self.size - Q + 1 - self.k * Q
        order = np.argsort(all_grams, kind="stable")  # by q-gram, item and place
        g, item, place = all_grams[order], item[order], place[order]
        apart = (g[1:] != g[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > self.k[item[1:]] + 1)
        head = np.flatnonzero(np.r_[np.ones(min(1, len(g)), bool), apart])
        self.item, self.first, self.last = item[head], place[head], place[np.r_[head[1:], len(g)] - 1]
        self.grams, begin = np.unique(g[head], return_index=True)
        self.begin = np.r_[begin, len(head)]
        self.cells = np.zeros(1 << _BITS, bool)
        self.cells[_cell(self.grams)] = True

    def hits(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(places in data, numbers of their q-grams, where the next part starts), a stretch at a time."""
        for start in range(0, len(data) - Q + 1, STRETCH):
            g = grams(data[start : start + STRETCH + Q - 1])
            at = np.flatnonzero(self.cells[_cell(g)])
            found = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
            real = self.grams[found] == g[at]
            at, found = at[real] + start, found[real]
            total = np.cumsum(self.begin[found + 1] - self.begin[found])
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + EVENTS, "right")))
                yield at[i:j], found[i:j], int(at[j]) if j < len(at) else start + STRETCH
                i = j

    def bands(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(item, first diagonal) of the bands with enough shared q-grams.

        A place in the data and a run give a stretch of bands, told by its two ends; a place counts
        once in a band, however often the item repeats its q-gram.  A band is judged and forgotten as
        soon as no later place reaches it, so memory depends on neither the data's length nor on
        what it repeats.
        """
        shift, zero = np.int64(1 << 40), np.int64(1 << 30)
        keys = change = np.zeros(0, np.int64)
        for at, found, following in self.hits(data):
            n = self.begin[found + 1] - self.begin[found]
            slot = np.repeat(self.begin[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            item, place = self.item[slot], np.repeat(at, n)
            step = self.k[item] + 1
            # Each diagonal lies in the band that starts in its step and in the one before.
            low = item * shift + zero + (place - self.last[slot]) // step - 1
            high = item * shift + zero + (place - self.first[slot]) // step + 1
            one = np.ones(len(item), np.int64)
            keys, where = np.unique(np.r_[keys, low, high], return_inverse=True)
            change = np.bincount(where, np.r_[change, one, -one]).astype(np.int64)
            begin, end, count = keys[:-1], keys[1:], np.cumsum(change)[:-1]
            item = begin // shift
            open_ = item * shift + zero + (following - self.size[item]) // (self.k[item] + 1) - 1
            yield from self._judged(begin, np.minimum(end, open_), count)
            begin = np.maximum(begin, open_)
            live = (begin < end) & (count > 0)
            keys, change = np.r_[begin[live], end[live]], np.r_[count[live], -count[live]]
        keys, where = np.unique(keys, return_inverse=True)
        change = np.bincount(where, change, len(keys)).astype(np.int64)
        yield from self._judged(keys[:-1], keys[1:], np.cumsum(change)[:-1])

    def _judged(self, begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
        shift, zero = np.int64(1 << 40), np.int64(1 << 30)
        enough = (begin < end) & (count >= self.least[begin // shift])
        for a, b in zip(begin[enough].tolist(), end[enough].tolist()):
            item = a >> 40
            step = int(self.k[item]) + 1
            base = (item << 40) + int(zero)
            yield from ((item, (band - base) * step) for band in range(a, b))


class Short:
    """Items under `MIN_CHARS` characters, found exactly where no letter or digit goes on."""

    def __init__(self, ids: list, items: list[bytes]):
        self.tree = ahocorasick.Automaton()
        same: dict[bytes, list] = {}
        for i, x in zip(ids, items):
            same.setdefault(x, []).append(i)
        for x, own in same.items():
            self.tree.add_word(x.decode("latin-1"), (own, len(x)))
        self.tree.make_automaton()

    def search(self, raw: bytes) -> Iterator[tuple]:
        edge = b"\0" + raw.translate(_INSIDE) + b"\0"
        for last, (own, n) in self.tree.iter(raw.decode("latin-1")):
            first, end = last + 1 - n, last + 1
            if not (edge[first] and edge[first + 1]) and not (edge[end] and edge[end + 1]):
                yield from ((i, first, end, 0) for i in own)


def align(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the item's best place in a region, if within k edits.

    Rows are the item's bytes; a row is one vector over the region.  The region is already no
    longer than the item and the band, so the band is the row.
    """
    exact = region.find(item)
    if exact >= 0:
        return 0, exact, exact + len(item)
    r = np.frombuffer(region, np.uint8)
    n = len(r)
    ramp = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), ramp.copy()
    for i, c in enumerate(item):
        mismatch = np.r_[0, (r != c).astype(np.int64)]
        down = cost + 1  # the item's byte is missing in the region
        diagonal = np.r_[len(item) + n, cost[:-1]] + mismatch
        new = np.minimum(down, diagonal)
        source = np.where(diagonal <= down, np.r_[0, origin[:-1]], origin)
        # Extra bytes of the region: the running minimum of cost less place.
        packed = (new - ramp) * (n + 1) + ramp
        best = np.minimum.accumulate(packed)
        left = best % (n + 1)
        cost, origin = new[left] + ramp - left, source[left]
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(origin[end]), end) if cost[end] <= k else None


def search(index: Index | None, texts: list[str], short: Short | None = None) -> list[list[tuple]]:
    raw = [plain(t) for t in texts]
    out: list[dict[tuple, None]] = [{} for _ in texts]
    if short:
        for d, r in enumerate(raw):
            out[d].update(dict.fromkeys(short.search(r)))
    if index is None:
        return [list(x) for x in out]
    data = b"\0".join(raw) + b"\0" * 8
    starts = np.r_[0, np.cumsum([len(r) + 1 for r in raw])]
    known: dict[tuple[int, bytes], tuple | None] = {}  # what repeats gives the same region again and again
    for i, diagonal in index.bands(data):
        item, k = index.items[i], int(index.k[i])
        low, high = diagonal - k, diagonal + 2 * k + 1 + len(item) + k
        for d in range(max(0, int(np.searchsorted(starts, low, "right")) - 1), min(len(texts), int(np.searchsorted(starts, high)))):
            a, b = max(low - int(starts[d]), 0), min(high - int(starts[d]), len(raw[d]))
            if b - a < len(item) - k:
                continue
            region = raw[d][a:b]
            key = i, xxhash.xxh3_128_digest(region)
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[key] = align(item, region, k)
            got = known[key]
            if got:
                out[d][index.ids[i], a + got[1], a + got[2], got[0]] = None
    return [list(x) for x in out]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", short: bool = True) -> DataFrame:
    items = benchmark.select("item_id", F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_blocks = size // BLOCK + 1
    out = docs.drop("matches").withColumn("matches", F.array().cast(MATCH))
    schema = extended(docs.schema, matches=MATCH)
    keep = [f.name for f in schema.fields if f.name != "matches"]

    def passing(long_items: list[tuple], short_items: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, few = (kind(*map(list, zip(*own))) if own else None for kind, own in ((Index, long_items), (Short, short_items)))
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
            for batch in batches:
                for part, found in ((p, search(index, t, few)) for p, t in blocks(batch, text)):
                    names = ("item_id", "first", "end", "edits")
                    had = part.column("matches").to_pylist()
                    made = [h + [dict(zip(names, m)) for m in sorted(f, key=str)] for h, f in zip(had, found)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, kind)], names=[*keep, "matches"])

        return run

    for b in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        rows = [(r.item_id, r.text.strip(SPACE_CHARS), plain(r.text)) for r in own.orderBy("item_id", "text").collect()]
        long_items = [(i, p) for i, t, p in rows if len(t) >= MIN_CHARS]
        short_items = [(i, plain(t)) for i, t, _ in rows if short and 0 < len(t) < MIN_CHARS]
        if long_items or short_items:
            out = out.select(*keep, "matches").mapInArrow(passing(long_items, short_items), schema)
    return out


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
