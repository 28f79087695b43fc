"""Periodic runs of words, found in a grammar of each text.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new one (the older pair first
among equals) until no pair occurs twice; what is left is the top sequence over a set of rules.
Equal passages are derived from the same symbols, so their inside is looked at once:

1. A run that lies in the text of a rule X -> Y Z and in neither half crosses the boundary of Y and
   Z.  Such runs are looked for once a rule, at its first derivation; a run in no rule crosses a
   boundary of the top sequence.
2. The runs of a rule are moved to all positions that derive it.
3. Intervals of one period that overlap by a period or more are merged; one inside another whose
   period divides its own goes.

At a boundary, a run of period q and length four q or more repeats the 2^k words on one side of
the boundary at distance q, for the k with 2^k <= q < 2^(k+1); so only the distances to equal
stretches are tried, which are few unless the stretch is itself periodic.  Stretches of 2^k words
are named level by level, among those that occur twice.

Contract of `find_runs`: returns every row and column of docs with `n_words` long, `runs`
(array of struct<start, length, period>, by start, then period; word numbers from 0) and
`collapsed` string (the words that no run repeats, joined by one space), which replace columns of
those names.  A run has the smallest period q, a length of at least max(6, 4 * q), and no
neighbouring word extends it.  A null or empty text has no words and no runs; repeated rows are
searched each; an empty table gives an empty table.  Texts are whole at every length: one text is
in memory at a time, besides its batch.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import agreeing, map_texts, query, table, text_of
from .quality_rules import let, words_of

LEAST, REPEATS = 6, 4  # a run has LEAST words at least, and REPEATS periods


class Grammar:
    """Re-Pair over word ids.

    pairs: the two halves of each rule, whose number is the count of ids plus its place; first: where
    it is derived first; size: of each symbol its words; top: (position, symbol) of the top sequence.
    """

    def __init__(self, words: list[int], repeated: dict[tuple[int, int], list[int]]):
        n = len(words)
        self.base = base = max(words, default=-1) + 1
        self.pairs: list[tuple[int, int]] = []
        self.first: list[int] = []
        sizes: list[int] = []
        symbol = list(words)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = repeated
        queue = [(-len(at), k, pair) for k, (pair, at) in enumerate(found.items())]
        heapq.heapify(queue)
        age = len(queue)
        while queue:
            count, born, pair = heapq.heappop(queue)
            a, b = pair
            there, live, busy = [], [], -1
            for i in found[pair]:
                if symbol[i] == a and (j := after[i]) < n and symbol[j] == b:
                    there.append(i)
                    if i != busy:
                        live.append(i)
                        busy = j
            if len(live) < -count:  # without overlaps, and what other rules took
                found[pair] = there
                if len(live) > 1:
                    heapq.heappush(queue, (-len(live), born, pair))
                continue
            del found[pair]
            made = base + len(self.pairs)
            self.pairs.append(pair)
            self.first.append(live[0])
            sizes.append((sizes[a - base] if a >= base else 1) + (sizes[b - base] if b >= base else 1))
            new: dict[tuple[int, int], list[int]] = {}
            for i in live:
                j = after[i]
                symbol[i], symbol[j] = made, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    new.setdefault((made, symbol[k]), []).append(i)
                if (h := before[i]) >= 0:
                    new.setdefault((symbol[h], made), []).append(h)
            for pair, at in new.items():
                if len(at) > 1:
                    found[pair] = sorted(set(at))
                    heapq.heappush(queue, (-len(found[pair]), age, pair))
                    age += 1
        self.sizes = sizes
        self.top: list[tuple[int, int]] = []
        i = 0
        while i < n:
            self.top.append((i, symbol[i]))
            i = after[i]

    def size(self, symbol: int) -> int:
        return self.sizes[symbol - self.base] if symbol >= self.base else 1


class Repeats:
    """Where stretches of 2^k words occur again, from k = 2 on."""

    def __init__(self, starts: np.ndarray, names: np.ndarray, n: int):
        """starts: of the pairs of words that occur twice or more, in order; names: equal for equal pairs."""
        self.levels: list[tuple[dict[int, int], dict[int, tuple[int, int]], list[int]]] = []
        width, at = 2, np.full(n, -1, np.int64)
        while True:
            at.fill(-1)
            at[starts] = names
            starts = starts[starts + width < n]
            starts = starts[at[starts + width] >= 0]
            if not len(starts):
                break
            both = at[starts] * (names.max() + 1) + at[starts + width]
            _, names, counts = np.unique(both, return_inverse=True, return_counts=True)
            keep = counts[names] > 1
            starts, names, width = starts[keep], names[keep], 2 * width
            if not len(starts):
                break
            order = np.argsort(names, kind="stable")
            ends = np.cumsum(counts[counts > 1]).tolist()
            found = zip(np.flatnonzero(counts > 1).tolist(), zip([0, *ends[:-1]], ends))
            self.levels.append((dict(zip(starts.tolist(), names.tolist())), dict(found), starts[order].tolist()))

    def distances(self, level: int, start: int, forward: bool) -> list[int]:
        """Distances of 2^level up to twice that, from a stretch of 2^level words to equal ones."""
        if level - 2 >= len(self.levels):
            return []
        names, places, at = self.levels[level - 2]
        if (name := names.get(start)) is None:
            return []
        (low, high), least = places[name], 1 << level
        if forward:
            return [p - start for p in at[bisect_left(at, start + least, low, high) : bisect_left(at, start + 2 * least, low, high)]]
        return [start - p for p in at[bisect_right(at, start - 2 * least, low, high) : bisect_right(at, start - least, low, high)]]


def crossing(
    words: list[int], back: list[int], repeats: Repeats, low: int, b: int, high: int, known: list[tuple[int, int, int]] = []
) -> list[tuple[int, int, int]]:
    """(period, start, end) of the periodic stretches of words[low:high] that hold b - 1 and b, but the known ones.

    Of such a run one side of b has max(3, 2 q) words.  There the words from b - 1 to b + q recur
    at distance q, or those from b - q to b at distance -q.
    """
    n, w, out = len(words), words, []
    most = (high - low) // REPEATS

    def seen(q: int, start: int, end: int) -> bool:
        """Whether the stretch lies in a found one whose period divides q, and so has the same place."""
        return any(q % p == 0 and s <= start and end <= e for p, s, e in known) or any(
            q % p == 0 and s <= start and end <= e for p, s, e in out
        )

    def extend(q: int) -> None:
        places = set()  # words behind b repeat those at b, or these repeat others
        if b + q < high and w[b] == w[b + q] and w[b - 1] == w[b - 1 + q]:
            end = b + q + agreeing(w, w, b, b + q, high - b - q)
            places.add((b - agreeing(back, back, n - b, n - b - q, b - low), end))
        if b - 1 - q >= low and w[b] == w[b - q] and w[b - 1] == w[b - 1 - q]:
            end = b + agreeing(w, w, b - q, b, high - b)
            places.add((b - q - agreeing(back, back, n - b + q, n - b, b - q - low), end))
        out.extend((q, start, end) for start, end in places if end - start >= max(LEAST, REPEATS * q))

    for q in range(1, min(3, most) + 1):
        if b + 1 + q < high and w[b - 1] == w[b - 1 + q] and w[b] == w[b + q] and w[b + 1] == w[b + 1 + q]:
            if not seen(q, b - 1, b + 2 + q):
                extend(q)
        elif b - 2 - q >= low and w[b] == w[b - q] and w[b - 1] == w[b - 1 - q] and w[b - 2] == w[b - 2 - q]:
            if not seen(q, b - 2 - q, b + 1):
                extend(q)
    level = 2
    while 1 << level <= most:
        for q in repeats.distances(level, b - 1, True):
            if q > most or b + 2 * q > high:
                break
            if w[b + q - 1] == w[b + 2 * q - 1] and not seen(q, b - 1, b + 2 * q) and w[b - 1 : b + q] == w[b - 1 + q : b + 2 * q]:
                extend(q)
        for q in reversed(repeats.distances(level, b + 1 - (1 << level), False)):
            if q > most or b - 2 * q < low:
                break
            if w[b - q] == w[b - 2 * q] and not seen(q, b - 2 * q, b + 1) and w[b - q : b + 1] == w[b - 2 * q : b + 1 - q]:
                extend(q)
        level += 1
    return out


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    ids = np.array(words, np.int64)
    keys = ids[:-1] * (ids.max() + 1) + ids[1:]
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[names] > 1)
    if not len(starts):
        return []  # a run repeats its pairs of words
    repeated: dict[tuple[int, int], list[int]] = {}
    for i in starts.tolist():
        repeated.setdefault((words[i], words[i + 1]), []).append(i)
    repeats, back = Repeats(starts, names[starts], n), words[::-1]
    pair_starts = set(starts.tolist())
    grammar = Grammar(words, repeated)
    base, pairs = grammar.base, grammar.pairs

    inside: list[list[tuple[int, int, int]]] = []  # of each rule, by offset
    holds: list[bool] = []  # whether a rule or one it derives has runs
    for (y, z), at, size in zip(pairs, grammar.first, grammar.sizes):
        b = at + grammar.size(y)
        own = crossing(words, back, repeats, at, b, at + size) if size >= LEAST and b - 1 in pair_starts else []
        inside.append([(q, s - at, e - at) for q, s, e in own])
        holds.append(bool(own) or (y >= base and holds[y - base]) or (z >= base and holds[z - base]))

    found: set[tuple[int, int, int]] = set()
    known: list[tuple[int, int, int]] = []
    for at, symbol in grammar.top:
        if at and at - 1 in pair_starts:  # both words of the boundary recur together in a run
            known = [r for r in known if r[2] > at]
            known += crossing(words, back, repeats, 0, at, n, known)
            found.update(known)
        todo = [(at, symbol)] if symbol >= base and holds[symbol - base] else []
        while todo:
            i, x = todo.pop()
            found.update((q, i + s, i + e) for q, s, e in inside[x - base])
            y, z = pairs[x - base]
            for k, half in ((i, y), (i + grammar.size(y), z)):
                if half >= base and holds[half - base]:
                    todo.append((k, half))
    return _maximal(found)


def _maximal(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Merge the stretches of one period that share a period; drop those inside one whose period divides theirs."""
    merged: dict[int, list[list[int]]] = {}
    for q, start, end in sorted(found):
        own = merged.setdefault(q, [])
        if own and start <= own[-1][1] - q:
            own[-1][1] = max(own[-1][1], end)
        else:
            own.append([start, end])
    out = []
    for q, own in merged.items():  # in order of q
        smaller = [merged[p] for p in merged if p < q and q % p == 0]
        for start, end in own:
            if not any((k := bisect_right(other, start, key=lambda x: x[0])) and other[k - 1][1] >= end for other in smaller):
                out.append((start, end - start, q))
    return sorted(out)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: it isn't behind the first period of a run that holds it."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def found(texts: list[str]) -> dict[str, pa.Array]:
        sizes, runs, collapsed = [], [], []
        for t in texts:
            words = t.encode().split()  # by ASCII white space
            known: dict[bytes, int] = {}
            mine = runs_of([known.setdefault(w, len(known)) for w in words])
            sizes.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in mine])
            if mine:
                words = compress(words, kept_words(len(words), mine).tolist())
            collapsed.append(b" ".join(words).decode())
        return {"n_words": pa.array(sizes, pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.string())}

    return map_texts(
        docs, found, text, n_words="long", runs="array<struct<start:bigint,length:bigint,period:bigint>>", collapsed="string"
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with a tenth of the texts made periodic: a word behind a place is the one a multiple of p before it."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def of(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)

        def turned(at: Column) -> Column:
            p = 1 + F.floor((n - at) / (3 + g % 8))
            return F.array_join(
                F.transform(words, lambda w, i: F.when(i < at, w).otherwise(F.get(words, (at + (i - at) % p).cast("int")))), " "
            )

        return F.when(n > 0, let((g % n), turned)).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words_of(text_of()), of)).otherwise(text_of()))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs)
    most = F.aggregate(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best),
    )
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), told.alias("told"), "collapsed").select(
        "doc_id", "n_runs", "most.start", "most.length", "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
