"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes.  Where a token of each ends at the same byte, both texts are
cut; what lies between two cuts is a group, and the two tokens that end there are linked.

The end offsets of both are compared at a shift, the difference of the two positions at the last
cut.  While tokens stand one to one, the shift stays: a stretch of 1, 2, 4, ... ends of one side is
compared with as many of the other at once, and the block that differs is halved to find where.
What doesn't stand one to one is walked end by end to the next cut, which gives the new shift.

Links are counted over the corpus.  A block of texts (about 2 MB) asks once for each distinct
pair of ids in it; pairs are counted and the counts go back to the blocks that asked, so that a
pair that every document holds moves once a block, and no document's tokens are shuffled.

Contract of `align`: returns every row and column of docs (the text only with `keep_text`), with
`n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256` and, with
`keep_groups`, `groups` (`a1,a2|b1;a3|b2,b3`), which replace columns of those names.  A null or
empty text has no tokens, nor has one whose tokens don't join to a space and the text: zeros and
an empty string.  Repeated rows count each; an empty table gives an empty table.  Further columns
ride along in one struct, so that none clashes with a working column.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import agreeing, binary, blocks, materialise, nullable, query, table
from .token_counts import PROVEN

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary, for a faster library
PIECES = public_tokenizers.path("piece_bpe_32k.model")

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


# ---------------------------------------------------------------- alignment of one text


def cuts(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Of each group how many tokens of a, and of b, lie before its end; both end at the same byte."""
    i = j = 0
    a_cuts: list[int] = []
    b_cuts: list[int] = []
    n = len(a)
    while i < n:
        run = agreeing(a, b, i, j, min(n - i, len(b) - j))
        if run:
            a_cuts += range(i + 1, i + run + 1)
            b_cuts += range(j + 1, j + run + 1)
            i, j = i + run, j + run
            if i == n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        a_cuts.append(i)
        b_cuts.append(j)
    return a_cuts, b_cuts


# ---------------------------------------------------------------- tokens


def _byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """A vocabulary: of each id its bytes, their number, and how it is written in a group."""

    def __init__(self, entries: list[bytes]):
        self.bytes = entries
        self.sizes = np.array([len(e) for e in entries], np.int64)
        inner, last = [f"{i}," for i in range(len(entries))], self.LAST
        self.written = np.array(inner + [f"{i}{last}" for i in range(len(entries))], object)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])


class ByteSide(Side):
    LAST = "|"

    def __init__(self, path: str, ranks: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        chars = _byte_chars()
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        super().__init__([bytes(chars[c] for c in name) if all(c in chars for c in name) else name.encode() for name in names])
        with open(ranks, "rb") as f:
            known = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        if any(self.bytes[i] != k for k, i in known.items()):
            raise ValueError("the two files hold different vocabularies")
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The faster library where both hold the same Unicode tables, else the file's own."""
        out = []
        for t in texts:
            if PROVEN.fullmatch(t):
                out.append(self.fast.encode_ordinary(" " + t))
            else:
                out.append(self.library.encode(" " + t, add_special_tokens=False).ids)
        return out


class PieceSide(Side):
    LAST = ";"

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(entries)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(1)
def sides(path_a: str, ranks_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(path_a, ranks_a), PieceSide(path_b)


def written(a: ByteSide, b: PieceSide, ids_a, ids_b, cut_a, cut_b) -> str:
    """a1,a2|b1;a3|b2,b3"""
    size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[cut_a - 1] = last_b[cut_b - 1] = True
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + np.repeat(cut_b - size_b, size_a)] = a.written[ids_a + last_a * len(a.bytes)]
    out[np.arange(len(ids_b)) + np.repeat(cut_a, size_b)] = b.written[ids_b + last_b * len(b.bytes)]
    return "".join(out.tolist())[:-1]


def align_text(a: ByteSide, b: PieceSide, text: str, ids_a: list[int], ids_b: list[int]):
    """Numbers of tokens and groups, the groups written, and the linked pairs with how often; None without tokens."""
    if not text:
        return None
    want = b" " + text.encode()
    if b"".join(map(b.bytes.__getitem__, ids_b)) != want or b"".join(map(a.bytes.__getitem__, ids_a)) != want:
        return None
    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    cut_a, cut_b = map(np.array, cuts(a.ends(ids_a).tolist(), b.ends(ids_b).tolist()))
    pairs, times = np.unique(ids_a[cut_a - 1] * len(b.bytes) + ids_b[cut_b - 1], return_counts=True)
    return (len(ids_a), len(ids_b), len(cut_a)), written(a, b, ids_a, ids_b, cut_a, cut_b), pairs, times


# ---------------------------------------------------------------- Spark


def align(
    docs: DataFrame, tokenizer_a: str = BYTE_BPE, ranks_a: str = RANKS, tokenizer_b: str = PIECES,
    text: str = "text", keep_text: bool = True, keep_groups: bool = False,
) -> DataFrame:
    made = [*COUNTS, "n_best", "count_sum", "groups_sha256", "groups"]
    own = [c for c in docs.columns if c.lower() not in made and (keep_text or c != text)]
    packed = docs.select(
        F.col(text).cast("string").alias("text"), F.struct(F.lit(None).cast("boolean").alias("__row"), *[F.col(f"`{c}`") for c in own]).alias("row")
    )
    packed = packed.select("text", F.col("row").cast(nullable(packed.schema["row"].dataType)).alias("row"))
    paths = (tokenizer_a, ranks_a, tokenizer_b)
    width = sentencepiece.SentencePieceProcessor(model_file=tokenizer_b).get_piece_size()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(*paths)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in blocks(batch):
                number += 1
                found = [align_text(a, b, *x) for x in zip(texts, a.encode(texts), b.encode(texts))]
                sizes = np.array([f[0] if f else (0, 0, 0) for f in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), pa.array(np.full(len(found), number)),
                        *[pa.array(sizes[:, k]) for k in (0, 1, 2, 2)],
                        pa.array([hashlib.sha256(f[1].encode()).hexdigest() if f else "" for f in found]),
                        pa.array([(f[1] if f else "") if keep_groups else None for f in found], pa.string()),
                        binary(f[2].astype("<i8").tobytes() if f else b"" for f in found),
                        binary(f[3].astype("<i4").tobytes() if f else b"" for f in found),
                    ],
                    names=["row", "block", *COUNTS, "groups_sha256", "groups", "pairs", "times"],
                )

    fields = f"block long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, pairs binary, times binary"
    schema = packed.select("row").schema
    for field in fields.split(", "):
        schema = schema.add(*field.split(" "))
    found = materialise(packed.mapInArrow(aligned, schema), "aligned")
    answers = _counted(found.select("block", "pairs", "times"), width)

    def scored(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        """The counts of a block's pairs, summed over each of its texts."""
        pair = theirs.column("pair").to_numpy()
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], theirs.column("count").to_numpy()[order]
        best = theirs.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, total = [], []
        for keys, times in zip(ours.column("pairs").to_pylist(), ours.column("times").to_pylist()):
            at, k = np.searchsorted(pair, np.frombuffer(keys, "<i8")), np.frombuffer(times, "<i4").astype(np.int64)
            total.append(int((count[at] * k).sum()))
            n_best.append(int(k[best[at]].sum()))
        kept = ours.drop_columns(["block", "pairs", "times"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    out = schema_without(schema, "block", "pairs", "times").add("n_best", "long").add("count_sum", "long")
    back = found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, out)
    return back.select(*[F.col(f"row.`{c}`") for c in own], *[c for c in made if keep_groups or c != "groups"])


def schema_without(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in names])


def _counted(found: DataFrame, width: int) -> DataFrame:
    """Of each block and pair in it: the pair's count in the corpus, and whether its id of b has no higher one."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)) if len(block) else []
            for s, e in zip(starts, [*starts[1:], len(block)]):
                keys = np.frombuffer(b"".join(batch.column("pairs")[s:e].to_pylist()), "<i8")
                times = np.frombuffer(b"".join(batch.column("times")[s:e].to_pylist()), "<i4")
                pair, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), block[s])), pa.array(pair), pa.array(np.bincount(at, times, len(pair)).astype(np.int64))],
                    names=["block", "pair", "times"],
                )

    asking = materialise(found.mapInArrow(asked, "block long, pair long, times long"), "asked")
    counts = materialise(asking.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    counts = counts.withColumn("b", F.col("pair") % width)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    graded = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    return asking.select("block", "pair").join(graded, "pair").select("block", "pair", "count", "best")


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, keep_text=False).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
