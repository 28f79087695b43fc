"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. Each text becomes the set of its five-word shingles (64-bit hashes), a MinHash signature
   and a 128-bit key of the whole set.
2. Texts with equal sets are one node: the smallest doc_id stands for them.
3. Signatures are cut into bands.  In a band's bucket, every node is paired with the smallest
   node of the bucket, so a bucket of n nodes gives n - 1 pairs.
4. Pairs are compared batch by batch of signature values.  After each batch the posterior of
   the similarity (uniform prior) is known; a pair whose chance to reach the threshold is below
   `miss` is dropped.  The survivors are compared exactly, on full sets.
5. Verified links give components.  What a bucket's smallest node didn't link may still link
   to another member, so in buckets that hold several components the pairs across components
   are compared too, in blocks of at most `BLOCK` nodes a side.  A pair that shares several
   bands is compared in the first of them.  No link between texts that share a band is lost.

Contract of `near_duplicates`: returns every row and column of docs with `n_shingles`,
`component_id` and `kept`, which replace columns of those names.  A null or empty text has an
empty set, is linked with nothing and kept.  A text of fewer words than a shingle is one
shingle.  Rows that share a doc_id are one document: they have one component and stand or
fall together.  A row without doc_id has no component and is kept.  An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, join_hashes, map_texts, materialise, mix, partitions, query, rolling, set_aside, table

SHINGLE = 5
SIMILAR = (75, 100)  # linked when 100 * intersection >= 75 * union
BANDS, ROWS = 32, 4
LENGTH = 512  # signature values; the bands are cut from the first BANDS * ROWS
BATCH, MISS = 32, 1e-4
BLOCK = 1024


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles."""
    words = Words(texts, lower=True)
    h = words.hashes()
    grams = rolling(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = mix(np.uint64([b - a]))
            for x in h[a:b]:
                whole = join_hashes(whole, np.uint64([x]))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(texts: list[str], bands: int, rows: int, k: int, length: int) -> dict[str, pa.Array]:
    """Shingle counts, set keys, 16-bit signature values and band keys."""
    odd = np.random.default_rng(20).integers(0, 2**31, length, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    sizes, keys, signs, band_keys = [], [], [], []
    for s in shingle_sets(texts, k):
        sizes.append(len(s))
        if not len(s):
            keys.append(None), signs.append(None), band_keys.append(None)
            continue
        least = np.full(length, 2**32 - 1, np.uint32)
        short = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(s), 1024):
            np.minimum(least, (short[None, at : at + 1024] * odd[:, None]).min(axis=1), out=least)
        keys.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], "<u8").tobytes())
        signs.append((least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2").tobytes())
        in_band = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
        folded = mix(np.arange(bands, dtype=np.uint64))
        for r in range(rows):
            folded = join_hashes(folded, in_band[:, r])
        band_keys.append(folded.view(np.int64))
    return {
        "n_shingles": pa.array(sizes, pa.int64()),
        "set_key": pa.array(keys, pa.binary()),
        "signature": pa.array(signs, pa.binary()),
        "bands": pa.array(band_keys, pa.list_(pa.int64())),
    }


def least_matches(n: int, miss: float, similar: tuple[int, int] = SIMILAR) -> int:
    """Of n signature values, how many must match for the pair to stay.

    With a uniform prior the similarity's posterior after m of n matches is Beta(m+1, n-m+1);
    it is at least t with probability P(Binomial(n+1, t) <= m).
    """
    t, tail = similar[0] / similar[1], 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def batches_of(length: int, batch: int, miss: float, similar: tuple[int, int]) -> list[tuple[int, int, int]]:
    ends = [min(i + batch, length) for i in range(0, length, batch)]
    return [(i, end, least_matches(end, miss, similar)) for i, end in zip(range(0, length, batch), ends)]


def stay(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """Indices of the pairs (rows of left and right) that no batch of values rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for start, end, least in steps:
        matches = matches + (left[alive, start:end] == right[alive, start:end]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def plausible(pairs: DataFrame, length: int, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs (a, b, sign_a, sign_b) that may be similar enough, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if got.num_rows:
                left, right = (_matrix(got.column(c), length) for c in ("sign_a", "sign_b"))
                yield got.select(["a", "b"]).take(pa.array(stay(left, right, steps)))

    return pairs.mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array, width: int, kind: str = "<u2") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def across(members: DataFrame, bands: int, length: int, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Plausible pairs (a, b) of one bucket and different roots.

    members: band, i, j, side, doc_id, root, signature, bands; rows of one (band, i, j) are
    compared, those with side 0 to those with side 1, or among themselves where i = j.
    """

    def compare(got: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, roots, side = (got[c].to_numpy() for c in ("doc_id", "root", "side"))
        signs, keys = _matrix(got["signature"], length), np.array(got["bands"].to_pylist(), np.int64).reshape(-1, bands)
        band, within = got["band"][0].as_py(), got["i"][0].as_py() == got["j"][0].as_py()
        at = int(np.argmax(keys[0] == band))
        left = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        for x in left.tolist():
            y = right[(roots[right] != roots[x]) & ((ids[right] > ids[x]) | (not within))]
            if at:
                y = y[~(keys[y, :at] == keys[x, :at]).any(axis=1)]
            if len(y):
                y = y[stay(np.broadcast_to(signs[x], (len(y), length)), signs[y], steps)]
            if len(y):
                one = np.full(len(y), ids[x])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, ids[y])), pa.array(np.maximum(one, ids[y]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for got in batches:
            if not got.num_rows:
                continue
            keys = np.stack([got.column(c).to_numpy() for c in ("band", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                key = tuple(keys[start])
                if key != last and held:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                held.append(got.slice(start, end - start))
                last = key
        if held:
            yield from compare(pa.Table.from_batches(held))

    order = ["band", "i", "j"]
    dealt = members.repartition(partitions(members.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough.  texts: one text of each node."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def full(batch: list[str]) -> dict[str, pa.Array]:
        return {"shingles": pa.array([s.tobytes() for s in shingle_sets(batch, k)], pa.binary())}

    sets = map_texts(texts.join(ends, "doc_id", "left_semi").select("doc_id", "text"), full, shingles="binary").drop("text")
    met = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "set_a"}), "a").join(
        sets.withColumnsRenamed({"doc_id": "b", "shingles": "set_b"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            keep = []
            for x, y in zip(got.column("set_a"), got.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(similar[1] * common >= similar[0] * (len(both) - common))
            yield got.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Every round sends each node's smallest neighbour to its larger neighbours and itself
    (large star), then joins what is left below each node to its smallest neighbour (small
    star); both are group-bys with map-side minima.  Rounds grow with the logarithm of a
    chain's length.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(
            met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        new = materialise(small, "edges")
        # Done when every node has one parent and no parent has a parent: all edges go to roots.
        parents = new.groupBy("u").agg(F.count("*").alias("n"))
        open_ = parents.where("n > 1").select("u").unionByName(new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi"))
        if open_.isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = new


def link_nodes(
    nodes: DataFrame, texts: DataFrame, ties: DataFrame, bands: int, k: int, similar: tuple[int, int], length: int, batch: int, miss: float
) -> DataFrame:
    """(node, root) of all nodes that a tie or a verified link reaches.  nodes: doc_id, signature, bands."""
    steps = batches_of(length, batch, miss, similar)
    spread = nodes.select("doc_id", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = materialise(spread.join(shared, "band"), "buckets")
    signs = nodes.select("doc_id", "signature")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.distinct(), "plausible")
        return materialise(verified(pairs, texts, k, similar).distinct(), "links")

    pairs = members.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    signed = pairs.join(signs.withColumnsRenamed({"doc_id": "a", "signature": "sign_a"}), "a").join(
        signs.withColumnsRenamed({"doc_id": "b", "signature": "sign_b"}), "b"
    )
    links = ties.unionByName(check(plausible(signed.select("a", "b", "sign_a", "sign_b"), length, steps)))
    roots = components(links)

    rooted = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "doc_id")), "rooted")
    split = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("band")
    # A bucket of more than BLOCK nodes is compared block against block.
    n_blocks = F.ceil(F.col("n") / BLOCK)
    dealt = rooted.join(split, "band").join(nodes, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), n_blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    dealt = dealt.select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "doc_id", "root", "signature", "bands",
    )
    found = check(across(dealt, bands, length, steps))
    return components(links.unionByName(found))


@set_aside("__text_key", "__n", "__component")
def near_duplicates(
    docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE,
    similar: tuple[int, int] = SIMILAR, length: int = LENGTH, batch: int = BATCH, miss: float = MISS, keep_text: bool = True,
) -> DataFrame:
    docs = docs.drop("n_shingles", "component_id", "kept")
    columns = [c for c in docs.columns if keep_text or c != text]
    keyed = docs.withColumn("__text_key", F.xxhash64(F.col(text)))
    own = keyed.where("doc_id is not null").select("doc_id", "__text_key", F.col(text).alias("text"))
    made = map_texts(
        own, lambda t: signatures(t, bands, rows, k, length),
        n_shingles="long", set_key="binary", signature="binary", bands="array<long>",
    )
    measured = materialise(made.drop("text"), "signatures")
    sets = measured.where("set_key is not null").select("doc_id", "set_key", "signature", "bands")

    # Equal sets are one node; an id with several texts ties their nodes together.
    firsts = sets.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    nodes = sets.join(firsts, "set_key").where("doc_id = first").select("doc_id", "set_key", "signature", "bands")
    nodes = materialise(nodes.dropDuplicates(["doc_id", "set_key"]).drop("set_key"), "nodes")
    members = materialise(sets.select("doc_id", "set_key").join(firsts, "set_key").select("doc_id", "first").distinct(), "members")
    several = members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    ties = members.join(several, "doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b")

    texts = own.drop("__text_key")
    roots = link_nodes(nodes, texts, ties, bands, k, similar, length, batch, miss)
    found = members.join(roots.withColumnRenamed("node", "first"), "first", "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("root", "first")).alias("component_id"))

    # The texts are joined to what was found, not written beside it; rows of one id and text are alike.
    sizes = measured.groupBy("doc_id", "__text_key").agg(F.first("n_shingles").alias("__n"))
    known = sizes.join(found, "doc_id", "left").select(
        "doc_id", "__text_key", "__n", F.coalesce("component_id", "doc_id").alias("__component")
    )
    rows_of = keyed.select(*columns, "__text_key") if keep_text else keyed.drop(text)
    with_id = rows_of.where("doc_id is not null").join(known, ["doc_id", "__text_key"]).select(
        *columns, F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"),
        (F.col("doc_id") == F.col("__component")).alias("kept"),
    )
    without = map_texts(
        docs.where("doc_id is null"), lambda t: {"n_shingles": pa.array([len(s) for s in shingle_sets(t, k)], pa.int64())}, text, n_shingles="long"
    )
    return with_id.unionByName(
        without.select(*columns, "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    )


@query("op10_near_dedup")
def op10_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, keep_text=False)
