"""Personal data and disclosing terms against regular expressions and plain counts in Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex

import __spark_entry__ as entry
from tidewatch.llm import sanitisation as san

PLAIN = {  # the patterns as the contract tells them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain_entities(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group())] for k, p in PLAIN.items()}


def runs(text):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", text)]


def nearest(text, back):
    words = runs(text[-san.SPAN :] if back else text[: san.SPAN])
    if back:
        words.reverse()
    if len(text) > san.SPAN:
        words = words[:-1]
    return words[: san.CONTEXT]


def brute(texts):
    """{text: (entities, disclosing terms)} by counting over the distinct texts."""
    distinct = set(texts)
    n_e, n_et, around = defaultdict(set), defaultdict(set), defaultdict(set)
    found = {t: plain_entities(t) for t in distinct}
    for t in distinct:
        for kind, p in PLAIN.items():
            every = [m.span() for m in re.finditer(p, t)]
            for i, (s, e) in enumerate(every):
                if (s, e) not in found[t][kind]:
                    continue
                value = t[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[s:e])
                before = nearest(t[every[i - 1][1] if i else 0 : s], True)
                behind = nearest(t[e : every[i + 1][0] if i + 1 < len(every) else len(t)], False)
                n_e[kind, value].add(t)
                for w in {w for w in before + behind if len(w) >= 3}:
                    n_et[kind, value, w].add(t)
                    around[kind, value, w].add(tuple(x for x in before[:2] + behind[:2] if x != w))
    terms = {}
    for (kind, value, w), held in n_et.items():
        if len(held) < san.SUPPORT or 2 * len(around[kind, value, w]) < len(held):
            continue
        n_t = sum(w in runs(t) for t in distinct)
        left = math.log2(n_t / len(held))
        gain = math.log2(len(distinct) * len(held) / (len(n_e[kind, value]) * n_t))
        if gain >= san.GAIN_BITS and left <= san.GENERALISE_BITS:
            terms[w] = min(left, terms.get(w, 9))
    return found, terms


def expected(text, found, terms):
    places = [s for k in PLAIN for s in found[k]]
    marked = [
        m.span() for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", text)
        if m.group().lower() in terms and not any(m.start() < e and s < m.end() for s, e in places)
    ]
    base = [f"{k}:{s}:{e}" for k in PLAIN for s, e in found[k]]
    return ",".join(base), ",".join(base + [f"term:{s}:{e}" for s, e in marked])


def corpus(seed=4):
    """Texts in which a code name stands beside one address, another term tells half as much, and copies tell nothing."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(60) for _ in range(120)]
    for k in range(6):
        texts.append(f"{prose(30)} {word()} {word()} Kestrel {word()} {word()} anna@mail.example.com {word()} {word()} {prose(30)}")
    texts.append(f"{prose(20)} KESTREL, without the address {prose(5)}")
    for k in range(5):
        texts.append(f"{prose(12)} {word()} merlin7 {word()} {word()} +1 (499) 555-65{k % 2}3 {word()} {word()} {prose(9)}")
        texts.append(f"{prose(12)} the merlin7 {prose(4)}")
    one = f"{prose(20)} {word()} zanzibar {word()} 10.20.30.40 {word()} {word()} {prose(20)}"
    texts += [one] * 5 + [one.replace(one.split()[k], word(), 1) for k in range(6)]
    texts += ["the common line of all to 4444333322221111 or the rest"] * 3
    rnd.shuffle(texts)
    return texts


def check(rows, texts):
    found, terms = brute(texts)
    for text, r in rows:
        base, spans = expected(text, found[text], terms)
        assert [r[f"n_{k}"] for k in san.KINDS] == [len(found[text][k]) for k in PLAIN], text
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        assert r.spans == spans, text
    return terms


def digest(docs):
    from pyspark.sql import functions as F

    return san.sanitise(docs).select(
        *docs.columns, *[F.size(f"found.{k}").alias(f"n_{k}") for k in san.KINDS], F.sha2(san.told("found", san.KINDS), 256).alias("base_sha256"),
        san.told("found", [*san.KINDS, "term"]).alias("spans"), "sanitised",
    ).collect()


def test_op13_query_equals_brute_force(spark, small, texts):
    rows = entry.queries()["op13_sanitisation"](spark, small).collect()
    assert len(rows) == len(texts)
    check([(texts[r.doc_id], r) for r in rows], list(texts.values()))
    assert sum(r.spans != "" for r in rows) > 5


def test_terms_that_give_an_entity_away(spark):
    texts = corpus()
    rows = digest(spark.createDataFrame([(t,) for t in texts], "text string"))
    terms = check([(r.text, r) for r in rows], texts)
    assert terms["kestrel"] < 0.25 and "zanzibar" not in terms
    for r in rows:
        if "KESTREL" in r.text:  # the term goes where the entity doesn't stand, too
            assert "KESTREL" not in r.sanitised and r.sanitised.count(" , without") == 1
        if "Kestrel" in r.text:
            assert "<EMAIL>" in r.sanitised and "Kestrel" not in r.sanitised
        if not r.spans:
            assert r.sanitised == r.text


def test_patterns_equal_the_plain_ones(spark):
    rnd = random.Random(8)
    parts = ["a", "B", "9", "12", "255", "256", "0001", ".", "..", "-", " ", "@", "_", "%", "+", "+1", "(499)", "x@y.z", "1.2.3.4", "4785380592391139", "é", "😀", "\n", "5 5 5"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    rows = digest(spark.createDataFrame([(t,) for t in texts], "text string").repartition(8))
    found = {t: plain_entities(t) for t in texts}
    for r in rows:
        base = ",".join(f"{k}:{s}:{e}" for k in PLAIN for s, e in found[r.text][k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), r.text


def test_long_texts_are_neither_slow_nor_deep(spark):
    texts = ["a" * 200_000 + " x@y.z", "a.b" * 60_000 + "@c" + ".d" * 60_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "+1 " * 50_000, "1.2.3.4 " * 3000, "a@b.c " * 3000]
    rows = {r.text: r for r in digest(spark.createDataFrame([(t,) for t in texts], "text string"))}
    assert [rows[t].n_email for t in texts] == [1, 1, 0, 0, 0, 0, 0, 3000]
    assert rows[texts[6]].n_ip == 3000


def test_native_plan(spark, small):
    plan = entry.queries()["op13_sanitisation"](spark, small)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def test_odd_rows(spark, odd, empty):
    clash = odd.selectExpr("*", "'f' AS found", "'s' AS sanitised", "'k' AS text_key", "'r' AS `row`", "'g' AS given", "'t' AS term")
    rows = san.sanitise(clash).collect()
    assert len(rows) == clash.count()
    assert sorted((str(r.doc_id), r.text or "", r.text is None) for r in rows) == sorted((str(i), t or "", t is None) for i, t, *_ in odd.collect())
    assert {(r.text_key, r.row, r.given, r.term, r.score) for r in rows} == {("k", "r", "g", "t", "s")}
    assert san.sanitise(empty).collect() == []


@pytest.mark.parametrize("digits, fits", [("4785380592391139", True), ("4785380592391138", False), ("0" * 16, True)])
def test_luhn(digits, fits):
    assert luhn(digits) is fits
