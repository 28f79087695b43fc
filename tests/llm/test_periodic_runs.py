"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from conftest import words

import __spark_entry__ as entry
from tidewatch.llm import periodic_runs


def brute_runs(w):
    """Maximal stretches of each period, longest periods last; a place keeps its smallest period."""
    n, places = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                places.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in places.items())


def brute_kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12_query_equals_brute_force(spark, small, texts):
    rows = entry.queries()["op12_periodic_runs"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = planted(r.doc_id, words(texts[r.doc_id]))
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(brute_kept(w, runs)))
    assert sum(r.n_runs > 0 for r in rows) > 10


def made(rnd):
    """Random words with periodic stretches, nested ones too, and repeated passages."""
    out = []
    letters = rnd.choice([1, 2, 3, 5, 50])
    for _ in range(rnd.randint(1, 8)):
        part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 14))]
        if rnd.random() < 0.5:
            inner = [rnd.randrange(letters)] * rnd.randint(1, 9)
            part = part[: rnd.randint(0, 4)] + inner
        kind = rnd.random()
        if kind < 0.5:
            part = part * rnd.randint(2, 9)
            part = part[: len(part) - rnd.randint(0, 3)]
        out += part
    if rnd.random() < 0.4:
        out = out + [rnd.randrange(letters)] + out * rnd.randint(1, 4)
    return out[:900]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        w = made(rnd)
        assert periodic_runs.runs_of(w) == brute_runs(w), w


def test_every_short_text_of_two_words():
    for n in range(13):
        for bits in range(1 << n):
            w = [bits >> k & 1 for k in range(n)]
            assert periodic_runs.runs_of(w) == brute_runs(w), w


def test_grammar_derives_the_text():
    rnd = random.Random(9)
    for _ in range(300):
        w = made(rnd)
        repeated = {}
        for i in range(len(w) - 1):
            repeated.setdefault((w[i], w[i + 1]), []).append(i)
        g = periodic_runs.Grammar(w, {k: v for k, v in repeated.items() if len(v) > 1})

        def derive(x):
            return [x] if x < g.base else derive(g.pairs[x - g.base][0]) + derive(g.pairs[x - g.base][1])

        assert [y for _, x in g.top for y in derive(x)] == w
        assert all(w[a : a + s] == derive(g.base + k) for k, (a, s) in enumerate(zip(g.first, g.sizes)))
        top = [x for _, x in g.top]
        seen = {}
        for i, pair in enumerate(zip(top, top[1:])):
            assert i - seen.setdefault(pair, i) <= 1, "a pair occurs twice without overlap"


def test_long_texts_stay_in_bounds():
    rnd = random.Random(2)
    block = [rnd.randrange(5000) for _ in range(3000)]
    w = block * 9 + [7] * 20_000 + [rnd.randrange(2) for _ in range(20_000)]
    runs = periodic_runs.runs_of(w)
    assert (0, 27_000, 3000) in runs and any(n >= 20_000 and q == 1 for _, n, q in runs)


def test_odd_rows(spark, odd, empty):
    clash = odd.selectExpr("*", "'r' AS runs", "'c' AS collapsed", "1 AS n_words", "'f' AS further")
    rows = periodic_runs.find_runs(clash).collect()
    assert len(rows) == clash.count()
    for r in rows:
        w = words(r.text)
        runs = [(x.start, x.length, x.period) for x in r.runs]
        if len(w) < 1000:
            assert runs == brute_runs(w)
        assert r.n_words == len(w) and r.collapsed == " ".join(brute_kept(w, runs))
        assert (r.score, r.further) == ("s", "f")
    assert periodic_runs.find_runs(empty).collect() == []
