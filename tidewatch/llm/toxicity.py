"""Toxicity through a noisy channel: restore what was disguised, then score the restored words.

A character trigram model is counted over the clean words of all documents.  A disguised
stretch - letters mixed with look-alike symbols, single letters with separators, letters
repeated - is a lattice: each character stands for itself, for the letters it can imitate, or
for nothing or a word's end (a separator, a repetition).  Viterbi decoding under the trigram model gives the
likeliest letters.  Stretches without any of these, and with letters at most doubled as in ordinary
spelling, aren't decoded; nor are marks that end a sentence, or that repeat thrice at a word's end.

Words of a bounded sample of labelled documents (`PER_CLASS` of each label, by hash), restored,
give the terms (a word, or its first four to six letters) that occur in more toxic than other
documents.  A document's evidence is the weight of its best terms; a logistic function fitted
on evidence from the other half of the sample turns it into a score.

Contract of `score`: returns every row and column of docs with `score` (0 to 1, higher: label
1 is likelier), which replaces a column of that name.  A null or empty text has no evidence
and the lowest score; repeated rows are scored each; an empty table gives an empty table.
Without toxic labels the score of every text is the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks, fold, map_texts, query, table
from .labelled import fit_logistic, labels_of, sample_ids

PER_CLASS = 4000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER = 27  # symbols of the trigram model: 0 none (word edge), 1 to 26 letters, 27 any other letter
SYMBOLS = 28

# What a character may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": LETTERS, "#": "h",
}
SEPARATORS = " .-_,/"
SUBSTITUTED, DELETED, WORD_BREAK, KEPT_REPEAT = log(0.3), log(0.3), log(0.1), log(0.05)

_MARK = "[" + re.escape("".join(LOOKALIKES)) + "]"
_TRIM = ".,;:!?\"'()[]{}&%#*"
_QUOTES = "".join(c for c in _TRIM if c not in LOOKALIKES)  # around a word these are no part of it
# Where a word's lattice has more than one path: a symbol between, before or after letters, three
# equal letters.  What _TRIM holds ends sentences, and a mark thrice at the end is emphasis.
DISGUISED = re.compile(
    rf"[^\W\d_][\W\d_]+[^\W\d_]|^{_MARK}+[^\W\d_]|[^\W\d_](?!.*(.)\1\1$)[\d@$|+€]+$|([^\W\d_])\2\2"
)
_TRIPLE = re.compile(r"(.)\1\1")
# Single characters, a letter among them, with any number of separators.
_ONE, _GAP = rf"(?:[^\W\d_]|{_MARK})", "[" + re.escape(SEPARATORS) + "]"
_SPACED = re.compile(rf"(?<![^\s{re.escape(_QUOTES + SEPARATORS)}]){_ONE}(?:{_GAP}+{_ONE}(?![^\W_]))+(?![^\W_])")
_GAPS = re.compile(rf"({_GAP})(?:{_GAP})+")


@dataclass
class Trigrams:
    """log P(letter | two before), as a table."""

    table: np.ndarray

    @staticmethod
    def from_counts(counts: np.ndarray) -> "Trigrams":
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.0
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1)) + 1.0
        p1 = c1 / c1.sum()
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
        return Trigrams(np.log(p3))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else OTHER


def decode(noisy: str, model: Trigrams) -> str:
    """The likeliest letters behind a disguised stretch (lower case)."""
    beam = {(0, 0): (0.0, None)}  # state: cost, and the letters so far as a chain
    before = ""
    for c in noisy:
        options = []
        if c.isalpha():
            options.append((c, KEPT_REPEAT if c == before else 0.0))
            if c == before:
                options.append(("", DELETED))
        else:
            options += [(x, SUBSTITUTED - (log(26) if c == "*" else 0.0)) for x in LOOKALIKES.get(c, "")]
            if c in SEPARATORS or c not in LOOKALIKES or c == before:
                options += [("", DELETED), (" ", WORD_BREAK)]
        nxt: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, done) in beam.items():
            for letter, extra in options:
                if letter:
                    s = symbol(letter)
                    state, total, text = (b, s), cost + extra + model.table[a, b, s], (done, letter)
                else:
                    state, total, text = (a, b), cost + extra, done
                if state not in nxt or total > nxt[state][0]:
                    nxt[state] = (total, text)
        beam = nxt
        before = c
    _, chain = max(((cost + model.table[a, b, 0], text) for (a, b), (cost, text) in beam.items()), key=lambda x: x[0])
    letters = []
    while chain:
        chain, letter = chain
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    def __init__(self, model: Trigrams, remembered: int = 200_000):
        self.model, self.known, self.remembered = model, {}, remembered

    def _word(self, word: str) -> str:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            got = self.known[word] = decode(word, self.model)
        return got

    def words(self, text: str) -> set[str]:
        """The distinct words of a text, in lower case, with restored ones beside the disguised."""
        text = text.lower()
        found = set(text.split())
        for m in _SPACED.finditer(text):
            if any(c.isalpha() for c in m.group()):
                found.update(self._word(_GAPS.sub(r"\1", m.group())).split())
        for w in list(found):
            if w.isalpha() and not _TRIPLE.search(w):
                continue
            for core in {w.strip(_TRIM), w.lstrip(_QUOTES).rstrip(_TRIM)}:
                if len(core) > 2 and DISGUISED.search(core):
                    found.update(self._word(core).split())
        return found


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Letter trigrams of all documents, in words of letters only; the sums are SYMBOLS ** 3 rows at most."""
    codes = np.full(256, OTHER, np.uint8)
    for i, c in enumerate(LETTERS):
        codes[ord(c)] = codes[ord(c) - 32] = i + 1
    codes[128:192] = 255  # continuation bytes
    codes[:65] = codes[91:97] = codes[123:128] = 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, texts in blocks(batch):
                a = codes[np.frombuffer("\n\n".join(["", *texts, ""]).encode(), np.uint8)]
                a = a[a < 255].astype(np.int32)
                total += np.bincount((a[:-2] * SYMBOLS + a[1:-1]) * SYMBOLS + a[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["trigram", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "trigram int, n long")
    counts = np.zeros(SYMBOLS**3)
    for r in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[r.trigram] = r.n
    return counts


def terms_of(words: set[str]) -> set[str]:
    plain = {w.strip(_TRIM) for w in words}
    return {w for w in plain if w} | {w[:n] + "~" for w in plain for n in (4, 5, 6) if len(w) >= n}


@dataclass
class Model:
    trigrams: Trigrams
    weights: dict[str, float] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)


def evidence(terms: set[str], weights: dict[str, float]) -> float:
    """Weights of the three best terms found."""
    found = sorted((weights[t] for t in terms & weights.keys()), reverse=True)[:3]
    return sum(w / (i + 1) for i, w in enumerate(found))


def weigh(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """log odds of terms that occur in clearly more toxic documents than in others."""
    out = {}
    for term, t in toxic.items():
        c = clean.get(term, 0)
        odds = log((t + 0.1) / (n_toxic + 0.2)) - log((c + 0.5) / (n_clean + 1))
        if t >= 2 and t / n_toxic > 3 * c / max(n_clean, 1) and odds - 1.5 / t**0.5 > 1:
            out[term] = odds
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """labels: doc_id and label, of the rows to learn from."""
    trigrams = Trigrams.from_counts(count_trigrams(docs, text))
    chosen = sample_ids(labels_of(labels, label), per_class)  # at most 2 * per_class rows, so it may be broadcast
    rows = docs.where("doc_id is not null").select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def restored(texts: list[str]) -> dict[str, pa.Array]:
        own = Restorer(trigrams)
        return {"terms": pa.array([sorted(terms_of(own.words(t))) for t in texts], pa.list_(pa.string()))}

    made = map_texts(rows.select("doc_id", "label", "part", "text"), restored, terms="array<string>").drop("text")
    sizes = {(r.label, r.part): r.n for r in made.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    n = {(y, p): sizes.get((y, p), 0) for y in (0, 1) for p in (0, 1)}
    if not (n[1, 0] + n[1, 1]) or not (n[0, 0] + n[0, 1]):
        return Model(trigrams)
    is_ = lambda y, p: F.sum(((F.col("label") == y) & (F.col("part") == p)).cast("int")).alias(f"n{y}{p}")
    counted = made.select("label", "part", F.explode("terms").alias("term")).groupBy("term").agg(
        *[is_(y, p) for y in (0, 1) for p in (0, 1)]
    ).where("n10 + n11 >= 2")  # terms of at most per_class documents
    toxic, clean = ({p: Counter() for p in (0, 1)} for _ in range(2))
    for r in counted.where("(n10 + n11) > (n00 + n01) * 0.01").collect():
        for p in (0, 1):
            toxic[p][r.term], clean[p][r.term] = r[f"n1{p}"], r[f"n0{p}"]
    both = weigh(toxic[0] + toxic[1], clean[0] + clean[1], n[1, 0] + n[1, 1], n[0, 0] + n[0, 1])
    halves = [weigh(toxic[1 - p], clean[1 - p], max(n[1, 1 - p], 1), n[0, 1 - p]) for p in (0, 1)]
    used = set().union(both, *halves)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [set(t) & used for t in b.column("terms").to_pylist()]
            x = [evidence(t, halves[p]) for t, p in zip(terms, b.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.float64())], names=["label", "x"])

    got = made.mapInArrow(scored, "label int, x double").collect()
    y, x = np.array([r.label for r in got], float), np.array([[r.x] for r in got])
    w = fit_logistic(x, y, ridge=0.01)
    return Model(trigrams, both, (float(max(w[0], 0.1)), float(w[1])))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    weights, (slope, bias) = model.weights, model.scale
    starts = {t[:4] for t in weights}
    short = {t for t in weights if len(t) < 4}

    def scored(texts: list[str]) -> dict[str, pa.Array]:
        own = Restorer(model.trigrams)
        x = []
        for t in texts:
            words = {w for w in own.words(t) if w[:4] in starts or w[0] in _TRIM or len(w) < 4 or w.strip(_TRIM) in short}
            x.append(evidence(terms_of(words), weights))
        z = slope * np.array(x) + bias
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())}

    return map_texts(docs, scored, text, score="double")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = score(docs, fit(docs, labels, "toxic"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
