"""Near-duplicates, repeated passages and line templates against brute force."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from tidewatch.llm import line_templates, near_dedup, substring_dedup
from tidewatch.llm.base import Words, mix, rolling


def words(text, lower=False):
    import re

    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def test_words_and_hashes():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \n\té日") for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["x" * 200 + " y", ""]
    w = Words(texts)
    h = w.hashes()
    seen = {}
    for i, t in enumerate(texts):
        own = [w.bytes[a:b].decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
        assert own == words(t)
        for word, x in zip(own, h[w.first[i] : w.first[i + 1]].tolist()):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 10, 20])
def test_rolling_depends_on_the_window_alone(k):
    h = mix(np.arange(1, 60, dtype=np.uint64))
    one = [rolling(h[i : i + k], k)[0] for i in range(60 - k)]
    assert rolling(h, k).tolist() == one and len(set(one)) == len(one)


def sets_of(texts, k=5):
    out = {}
    for i, t in texts.items():
        w = words(t, lower=True)
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for a, b in {p for ids in inverted.values() for p in itertools.combinations(ids, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_op10_query(spark, small, texts):
    sets = sets_of(texts)
    want = brute_components(sets)
    got = {r.doc_id: r for r in entry.queries()["op10_near_dedup"](spark, small).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def chain(seed=3, n=60, edits=4, length=150):
    """Copies of copies: neighbours are alike, ends are not."""
    rnd = random.Random(seed)
    now, out = [f"w{rnd.randrange(5000)}" for _ in range(length)], {}
    for i in rnd.sample(range(1000), n):
        out[i] = " ".join(now)
        for _ in range(edits):
            now = list(now)
            now[rnd.randrange(length)] = f"v{rnd.randrange(5000)}"
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_chains_and_stars(spark, monkeypatch, block):
    """Links that no bucket's smallest member has; small blocks split the buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = chain()
    star = random.Random(8)
    base = [f"s{star.randrange(5000)}" for _ in range(120)]
    for i in range(2000, 2060):
        copy = list(base)
        for _ in range(star.randrange(9)):
            copy[star.randrange(120)] = f"t{star.randrange(5000)}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(sets_of(texts))


def test_posterior_bound():
    assert near_dedup.least_matches(32, 1e-4) < near_dedup.least_matches(32, 1e-2) <= 24
    assert near_dedup.least_matches(512, 1e-4) / 512 > 0.65


def test_components_of_a_long_chain(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(1000), 90)
    links = [(ids[i], ids[i + 1]) for i in range(59)] + [(ids[i], ids[60]) for i in range(61, 90)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    lows = {x: min(part) for part in (ids[:60], ids[60:]) for x in part}
    assert got == {x: low for x, low in lows.items() if x != low}


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i in (1, 2, 3):
        assert [(r.n_shingles, r.component_id, r.kept) for r in by[i]] == [(0, i, True)]
    assert all(r.component_id is None and r.kept for r in by[None])
    assert {r.component_id for i in (7, 8, 12) for r in by[i]} == {7}  # id 12 has two texts, one like 7's
    assert [r.kept for r in by[7]] == [True, True] and not by[8][0].kept
    assert by[13][0].component_id == 6 and by[4][0].n_shingles == 1
    assert near_dedup.near_duplicates(empty).collect() == []


def brute_repeats(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_op6_query(spark, small, texts):
    rows = entry.queries()["op6_substring_dedup"](spark, small).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_repeats(texts)


def test_repeats_over_many_batches(spark, monkeypatch):
    rnd = random.Random(4)
    passages = [[f"p{rnd.randrange(300)}" for _ in range(rnd.randint(18, 60))] for _ in range(6)]
    texts = {}
    for i in rnd.sample(range(10_000), 160):
        parts = [[f"u{rnd.randrange(100_000)}" for _ in range(rnd.randint(0, 30))] for _ in range(4)]
        for p in rnd.sample(passages, 2):
            parts.insert(rnd.randrange(len(parts)), p)
        texts[i] = " ".join(x for p in parts for x in p)
    texts[20_000] = "a " * 75
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    got = substring_dedup.drop_repeats(docs).collect()
    want = brute_repeats(texts)
    for r in got:
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[r.doc_id]
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_packing():
    rnd = np.random.default_rng(1)
    for most in (50, 70_000):
        at = np.cumsum(rnd.integers(1, most, 500))
        tags, flags = rnd.integers(0, 2**32, 500, dtype=np.uint32), rnd.choice([0, 64, 128, 192], 500).astype(np.uint8)
        for a, b in zip(substring_dedup.unpack(substring_dedup.pack(tags, at, flags)), (tags, at, flags)):
            assert (a == b).all()


def test_repeats_of_odd_rows(odd, empty):
    rows = defaultdict(list)
    for r in substring_dedup.drop_repeats(odd).collect():
        rows[r.doc_id].append(r)
    assert sum(map(len, rows.values())) == odd.count()
    assert [r.n_removed for r in rows[7]] == [0, 0] and rows[8][0].kept_text == "" and rows[8][0].n_removed == 120
    assert all(r.n_removed == 0 for r in rows[None]) and rows[1][0].n_words == rows[2][0].n_words == 0
    assert rows[13][0].n_removed == 30_000 and rows[13][0].kept_text == "tail"
    assert substring_dedup.drop_repeats(empty).collect() == []


def test_templates_generalise_fields(spark):
    rows = [(i, f"{w}x {w}y {w}z here\nOrder {i * 7} shipped to {w} today\nkeep {w}q {w}r") for i, w in enumerate("abcdefghijkl" * 2)]
    rows += [(100, "Order 1 lost at sea today"), (101, None), (None, "Order 5 shipped to z today")]
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10)
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].n_dropped == 0 and by[0].n_lines == 3  # the first document keeps its lines
    assert "shipped" not in by[5].text and by[5].text == "fx fy fz here\nkeep fq fr"
    assert by[100].n_dropped == 0 and by[101].text is None and by[101].n_lines == 0
    assert by[None].text == "Order 5 shipped to z today"


def test_templates_of_odd_rows(odd, empty):
    rows = line_templates.drop_templates(odd, min_docs=2).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[2][0].n_lines == 1
    assert all(r.n_dropped == 0 for r in rows)  # lines of variable fields alone are no template
    assert line_templates.drop_templates(empty).collect() == []


def test_working_columns_of_templates_clash_with_nothing(spark, odd):
    names = ["dropped", "text_key", "form", "form_key", "leaf", "at", "row", "n", "first", "exact", "docs"]
    clash = odd.selectExpr("*", *[f"'{n}!' AS `{n}`" for n in names], "'gone' AS n_lines")
    got = line_templates.drop_templates(clash)
    assert got.columns == [c for c in clash.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(r[n] == f"{n}!" for r in rows for n in names)


def test_working_columns_of_duplicates_clash_with_nothing(spark, odd):
    names = ["text_key", "runs", "starts", "Runs2", "__text_key", "__n", "__component", "signature", "set_key", "root", "first", "band"]
    clash = odd.selectExpr("*", *[f"'{n}!' AS `{n}`" for n in names])
    for operator, made in (
        (substring_dedup.drop_repeats, ["n_words", "n_removed", "spans", "kept_text"]),
        (near_dedup.near_duplicates, ["n_shingles", "component_id", "kept"]),
    ):
        got = operator(clash)
        assert got.columns == [c for c in clash.columns if c not in made] + made
        rows = got.collect()
        assert len(rows) == odd.count() and all(r[n] == f"{n}!" for r in rows for n in names)


def dropped(spark, texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_templates(rows, **how).collect()}


def test_short_lines_recur_too(spark):
    got = dropped(spark, [f"Les.\nown{'abcdefghijkl'[i]}\n \n And \t ornd.\n{i}" for i in range(12)])
    assert got[0] == "Les.\nowna\n \n And \t ornd.\n0"
    assert all(got[i] == f"own{'abcdefghijkl'[i]}\n \n{i}" for i in range(1, 12))


def test_the_same_line_recurs_from_the_second_document(spark):
    long = " ".join(f"{a}{b}" for a in "abcdefghi" for b in "klmnopqrstu")
    page, order = "Printed on page 7 of the 3rd book", "Order {} shipped to {} today"
    texts = [f"{long}\n{page}", f"one\n{long}", f"two\n {page}  ", f"three\n{page.replace('7', '8')}"]
    got = dropped(spark, texts + [order.format(i, "abcd"[i]) for i in range(4)] + ["1 2 3 4", "1 2 3 4"])
    assert got == {
        0: texts[0], 1: "one", 2: "two", 3: texts[3], **{4 + i: order.format(i, "abcd"[i]) for i in range(4)}, 8: "1 2 3 4", 9: "1 2 3 4",
    }


def test_a_common_opening_is_no_template(spark):
    import string

    letters = string.ascii_lowercase
    tails = [f"{a}{b}x {b}{a}y" for a in letters[:6] for b in letters[:5]]
    clean = [f"It was a {t}" for t in tails]
    page = [f"Page views : {i}" for i in range(30)]
    got = dropped(spark, clean + page + ["Page views : many"])
    assert [got[i] for i in range(30)] == clean
    assert [got[30 + i] for i in range(30)] == [page[0]] + [""] * 29 and got[60] == "Page views : many"
    crowd = [f"It was a {a}{b}{c} {'night' if a == 'a' else c + b + a}" for a in letters for b in letters[:6] for c in letters[:4]]
    assert list(dropped(spark, crowd).values()) == crowd  # 24 of 624 end alike
