"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped.

Counting is two shuffles of packed, locally summed arrays, each dealt into buckets:

* words by hash: a bucket becomes one sorted file of word hashes with their counts; the number
  of a word is its place in all files together;
* pairs (word before, word) of word numbers: a bucket becomes one sorted file of pairs with
  their counts, from which come each first word's total and numbers of pairs seen once, twice
  and more; how many different words come before a word is summed in a third, small shuffle.

Scoring maps the files into memory, so all workers of a machine share one copy in its page
cache, and finds a text's words and pairs by binary search.  A word costs

    log10( max(c(v w) - D(c), 0) / c(v .) + g(v) * p(w) ),   p(w) from the number of words
    seen before w in the same way, over 1 / (V + 1) for words never seen

with the three discounts of each order from the counts of counts.  Files are written under the
shared folder, which the workers must see as a mounted path; each under a name of its own
that is put in place when complete, so a task that runs twice does no harm.

Contract of `score`: returns every row and column of docs with `n_tokens`, `n_known`,
`base_score`, `score` (log10 probabilities of the text under the unigram base and under the
model) and `perplexity`, which replace columns of those names.  A text is its words, A-Z
lower-cased, and one end; a null or empty text is its end alone.  Repeated rows count and are
scored each.  With nothing to learn from, every word has the probability of an unseen one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, blocks, fold, map_texts, new_path, partitions, query, table

END = np.uint64(2**64 - 1)  # the end's place among the word hashes: the last one
HELD = 1 << 22  # entries that a counting task holds before it sends them


def local_path(url: str) -> str:
    """The path of a shared folder as every machine has it mounted."""
    scheme, _, rest = url.partition(":")
    if rest and scheme != "file":
        raise ValueError(f"the model is memory-mapped: name a mounted shared folder in spark.checkpoint.dir, not {url}")
    return "/" + rest.lstrip("/") if rest else url


def _save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


@lru_cache(maxsize=4)
def _mapped(folder: str, kind: str, n: int) -> list[np.ndarray]:
    return [np.load(f"{folder}/{kind}{i}.npy", mmap_mode="r") for i in range(n)]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text, and where each text's tokens begin."""
    words = Words(texts, lower=True)
    n = np.diff(words.first) + 1
    begin = np.r_[0, np.cumsum(n)]
    out = np.full(begin[-1], END)
    at = np.ones(begin[-1], bool)
    at[begin[1:] - 1] = False
    out[at] = np.minimum(words.hashes(), END - np.uint64(1))
    return out, begin


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts[:0]


def _dealt(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, width: str = "<u8") -> pa.RecordBatch:
    """Sorted keys and their counts as one row per bucket; cuts: where each bucket begins."""
    some = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([
        pa.array(some.astype(np.int32)),
        pa.array([keys[cuts[i] : cuts[i + 1]].astype(width).tobytes() for i in some], pa.binary()),
        pa.array([counts[cuts[i] : cuts[i + 1]].astype("<u4").tobytes() for i in some], pa.binary()),
    ], names=["bucket", "keys", "counts"])


PACKED = "bucket int, keys binary, counts binary"


def _merged(batches: Iterator[pa.RecordBatch], width: str = "<u8") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per bucket the summed entries, from input sorted by bucket."""
    def close():
        return (last, *_summed(np.concatenate(keys).astype(np.uint64), np.concatenate(counts).astype(np.int64)))

    last, keys, counts = None, [], []
    for got in batches:
        for b, k, c in zip(*(got.column(x).to_pylist() for x in ("bucket", "keys", "counts"))):
            if keys and b != last:
                yield close()
                keys, counts = [], []
            last = b
            keys.append(np.frombuffer(k, width))
            counts.append(np.frombuffer(c, "<u4"))
            if len(keys) > 64:  # what is held stays near the bucket's own size
                k1, c1 = _summed(np.concatenate(keys).astype(np.uint64), np.concatenate(counts).astype(np.int64))
                keys, counts = [k1], [c1]
    if keys:
        yield close()


def _by_bucket(packed: DataFrame) -> DataFrame:
    return packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


@dataclass(frozen=True)
class Model:
    """Where the files are, and the few numbers that go with them."""

    folder: str
    buckets: int
    n_words: int  # V: distinct training tokens
    n_tokens: int  # N: training tokens
    offsets: tuple[int, ...]  # number of the first word of each bucket, and V
    discounts: tuple[tuple[float, float, float], tuple[float, float, float]]  # of pairs; of continuations
    before: int  # distinct pairs
    left: float  # weight of 1 / (V + 1) in p(w)

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Places of sorted distinct hashes among the words; -1: never seen."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(_bucket_of(hashes, self.buckets), np.arange(self.buckets + 1))
        for b, known in enumerate(_mapped(self.folder, "words", self.buckets)):
            own = hashes[cuts[b] : cuts[b + 1]]
            if len(own) and len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out[cuts[b] : cuts[b + 1]] = np.where(known[at] == own, self.offsets[b] + at, -1)
        return out

    def lookup(self, kind: str, numbers: np.ndarray) -> np.ndarray:
        """Values of a per-word file at word numbers in ascending order (never -1)."""
        files = _mapped(self.folder, kind, self.buckets)
        cuts = np.searchsorted(numbers, self.offsets)
        parts = [files[b][numbers[cuts[b] : cuts[b + 1]] - self.offsets[b]] for b in range(self.buckets)]
        return np.concatenate(parts)

    def pair_counts(self, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs; first: the pairs' first words (the number V is a text's begin)."""
        out = np.zeros(len(pairs), np.int64)
        cuts = np.searchsorted(first, self.offsets)
        cuts[-1] = len(first)  # a text's begin is kept in the last bucket
        keys, counts = (_mapped(self.folder, k, self.buckets) for k in ("pairs", "counts"))
        for b in range(self.buckets):
            own = pairs[cuts[b] : cuts[b + 1]]
            if len(own) and len(keys[b]):
                at = np.minimum(np.searchsorted(keys[b], own), len(keys[b]) - 1)
                out[cuts[b] : cuts[b + 1]] = np.where(keys[b][at] == own, counts[b][at], 0)
        return out


def _bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; without enough of them, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(found, 1))


def _spectrum(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _pairs_of(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes' distinct values, their numbers, each token's place among them, text begins."""
    h, begin = tokens(texts)
    unique, inverse = np.unique(h, return_inverse=True)
    return unique, model.word_numbers(unique), inverse, begin


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    spark = docs.sparkSession
    folder = local_path(folder or new_path(spark, "bigrams"))
    n = partitions(spark)
    texts = docs.select(F.col(text).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, part in blocks(batch):
                k, c = np.unique(tokens(part)[0], return_counts=True)
                keys, counts = _summed(np.r_[keys, k], np.r_[counts, c])
                if len(keys) > HELD:
                    yield _dealt(keys, counts, np.searchsorted(_bucket_of(keys, n), np.arange(n + 1)))
                    keys, counts = keys[:0], counts[:0]
        yield _dealt(keys, counts, np.searchsorted(_bucket_of(keys, n), np.arange(n + 1)))

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys, counts in _merged(batches):
            _save(folder, f"words{b}", keys)
            _save(folder, f"uses{b}", counts)
            yield pa.RecordBatch.from_pydict({"bucket": [b], "words": [len(keys)], "tokens": [int(counts.sum())]})

    rows = _by_bucket(texts.mapInArrow(count_words, PACKED)).mapInArrow(save_words, "bucket long, words long, tokens long").collect()
    got = {r.bucket: r for r in rows}
    for b in set(range(n)) - set(got):
        _save(folder, f"words{b}", np.zeros(0, np.uint64))
        _save(folder, f"uses{b}", np.zeros(0, np.int64))
    sizes = [got[b].words if b in got else 0 for b in range(n)]
    offsets = tuple(int(x) for x in np.r_[0, np.cumsum(sizes)])
    if offsets[-1] >= 2**32 - 1:
        raise ValueError("word numbers have 32 bits")
    words = Model(folder, n, offsets[-1], sum(r.tokens for r in rows), offsets, ((0.5, 1.0, 1.5),) * 2, 0, 1.0)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            first = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(first, words.offsets)
            cuts[-1] = len(first)
            return _dealt(keys, counts, cuts)

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, part in blocks(batch):
                _, numbers, inverse, begin = _pairs_of(words, part)
                w = numbers[inverse].astype(np.uint64)
                v = np.r_[np.uint64(0), w[:-1]]
                v[begin[:-1]] = words.n_words
                k, c = np.unique(v << np.uint64(32) | w, return_counts=True)
                keys, counts = _summed(np.r_[keys, k], np.r_[counts, c])
                if len(keys) > HELD:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    # Per first word: total, and numbers of pairs seen once, twice, more often.
    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys, counts in _merged(batches):
            _save(folder, f"pairs{b}", keys)
            _save(folder, f"counts{b}", counts.astype(np.uint32))
            base = words.offsets[b]
            first = (keys >> np.uint64(32)).astype(np.int64) - base
            size = words.offsets[b + 1] - base + (b == n - 1)
            stats = [np.bincount(first, counts, size)] + [
                np.bincount(first[own], minlength=size) for own in (counts == 1, counts == 2, counts > 2)
            ]
            _save(folder, f"firsts{b}", np.stack(stats, axis=1).astype(np.int64))
            seconds, before = np.unique(keys & np.uint64(2**32 - 1), return_counts=True)
            one = _dealt(seconds, before, np.searchsorted(seconds, np.array(words.offsets, np.uint64)), "<u4")
            facts = [b, len(keys), *_spectrum(counts)]
            yield pa.RecordBatch.from_arrays(
                [*one.columns, pa.array([facts] + [None] * (one.num_rows - 1), pa.list_(pa.int64()))], names=[*one.schema.names, "facts"]
            )

    counted = _by_bucket(texts.mapInArrow(count_pairs, PACKED)).mapInArrow(save_pairs, PACKED + ", facts array<long>")

    def save_befores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = []

        def passed():
            for b in batches:
                facts.extend(x for x in b.column("facts").to_pylist() if x)
                yield b

        for b, seconds, before in _merged(passed(), "<u4"):
            full = np.zeros(words.offsets[b + 1] - words.offsets[b], np.int64)
            full[seconds.astype(np.int64) - words.offsets[b]] = before
            _save(folder, f"befores{b}", full)
            yield pa.RecordBatch.from_pydict({"kind": [1], "facts": [[b, int(full.sum()), *_spectrum(full), int((full > 2).sum())]]})
        if facts:
            yield pa.RecordBatch.from_pydict({"kind": [0] * len(facts), "facts": facts})

    rows = _by_bucket(counted).mapInArrow(save_befores, "kind long, facts array<long>").collect()
    pairs = {r.facts[0]: r.facts[1:] for r in rows if r.kind == 0}
    befores = {r.facts[0]: r.facts[1:] for r in rows if r.kind == 1}
    for b in set(range(n)) - set(pairs):
        _save(folder, f"pairs{b}", np.zeros(0, np.uint64))
        _save(folder, f"counts{b}", np.zeros(0, np.uint32))
        _save(folder, f"firsts{b}", np.zeros((sizes[b] + (b == n - 1), 4), np.int64))
    for b in set(range(n)) - set(befores):
        _save(folder, f"befores{b}", np.zeros(sizes[b], np.int64))
    pair_facts = np.array([*pairs.values(), [0] * 5]).sum(axis=0)
    word_facts = np.array([*befores.values(), [0] * 6]).sum(axis=0)
    discounts = discounts_of(*pair_facts[1:]), discounts_of(*word_facts[1:5])
    total = int(word_facts[0])
    left = float(np.dot(discounts[1], [word_facts[1], word_facts[2], word_facts[5]]) / total) if total else 1.0
    return Model(folder, n, words.n_words, words.n_tokens, offsets, discounts, total, left)


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.r_[0.0, discounts][np.minimum(counts, 3)], 0)


def log_probabilities(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens, known tokens, log10 probability under the base and the model."""
    unique, numbers, inverse, begin = _pairs_of(model, texts)
    known = numbers >= 0
    own = numbers[known]
    uses, before = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
    if len(own):
        uses[known], before[known] = model.lookup("uses", own), model.lookup("befores", own)
    base = np.log10((uses + 1) / (model.n_tokens + model.n_words + 1))
    p_word = model.left / (model.n_words + 1)
    if model.before:
        p_word = p_word + _discounted(before, model.discounts[1]) / model.before
    p_word = np.broadcast_to(p_word, uses.shape)

    w = numbers[inverse]
    v = np.r_[0, w[:-1]]
    v[begin[:-1]] = model.n_words
    p = p_word[inverse].copy()
    at = np.flatnonzero(v >= 0)
    if len(at) and model.before:
        firsts, place = np.unique(v[at], return_inverse=True)
        stats = np.zeros((len(firsts), 4), np.int64)
        inner = firsts < model.n_words
        if inner.any():
            stats[inner] = model.lookup("firsts", firsts[inner])
        if not inner.all():
            stats[~inner] = _mapped(model.folder, "firsts", model.buckets)[-1][-1]
        total = np.maximum(stats[:, 0], 1)
        weight = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(model.discounts[0]) / total, 1.0)
        p[at] *= weight[place]
        seen = w[at] >= 0
        keys = v[at][seen].astype(np.uint64) << np.uint64(32) | w[at][seen].astype(np.uint64)
        pairs, back = np.unique(keys, return_inverse=True)
        counts = model.pair_counts((pairs >> np.uint64(32)).astype(np.int64), pairs)[back]
        p[at[seen]] += _discounted(counts, model.discounts[0]) / total[place[seen]]
    ends = begin[:-1]
    return (
        np.diff(begin), np.add.reduceat(known[inverse].astype(np.int64), ends),
        np.add.reduceat(base[inverse], ends), np.add.reduceat(np.log10(p), ends),
    )


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    def scored(texts: list[str]) -> dict[str, pa.Array]:
        n, n_known, base, own = log_probabilities(model, texts)
        return {
            "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(own, pa.float64()),
            "perplexity": pa.array(10 ** np.minimum(-own / n, 300), pa.float64()),
        }

    return map_texts(docs, scored, text, n_tokens="long", n_known="long", base_score="double", score="double", perplexity="double")


@query("op2_language_model")
def op2_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 7)
    model = train(docs.where(remainder != 2))
    return score(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
