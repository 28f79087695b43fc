"""Alignment of two tokenizers against sets of offsets and plain counts."""

import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
import tokenizers

import __spark_entry__ as entry
from tidewatch.llm import alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(library, pieces, a, b, text):
    """Ids of A and B between common ends, by the set of offsets; None without tokens."""
    if not text:
        return None
    ids_a, ids_b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    want = (" " + text).encode()
    if b"".join(a.bytes[i] for i in ids_a) != want or b"".join(b.bytes[i] for i in ids_b) != want:
        return None

    def placed(ids, side):
        at, out = 0, []
        for i in ids:
            at += len(side.bytes[i])
            out.append((at, i))
        return out

    pa, pb = placed(ids_a, a), placed(ids_b, b)
    both = {e for e, _ in pa} & {e for e, _ in pb}

    def split(placed):
        out = [[]]
        for end, i in placed:
            out[-1].append(i)
            if end in both:
                out.append([])
        return out[:-1]

    groups = list(zip(split(pa), split(pb)))
    return groups


def brute(rows):
    library = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    a, b = alignment.sides(alignment.BYTE_BPE, alignment.RANKS, alignment.PIECES)
    found = [plain_groups(library, pieces, a, b, t) for t in rows]
    links = Counter((x[-1], y[-1]) for g in found if g for x, y in g)
    top = {}
    for (_, y), n in links.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for g in found:
        if not g:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        mine = [(x[-1], y[-1]) for x, y in g]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(links[m] == top[m[1]] for m in mine),
            sum(links[m] for m in mine), hashlib.sha256(told.encode()).hexdigest(),
        ))
    return out


def test_op11_query_equals_brute_force(spark, small, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute([texts[i] for i in ids])))
    rows = entry.queries()["op11_alignment"](spark, small).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id]


def test_odd_rows(spark, odd):
    rows = odd.collect()
    rows = [(i, t) for i, t, *_ in rows if len(t or "") < 20_000]
    more = [(20, "▁ a▁b"), (21, "<s> <|endoftext|> </s>"), (22, "x\x00y \t  z\r\n"), (23, "ﬁne ½ Ⅷ"), (24, "🙂🙃 ok"), (25, "�")]
    rows += more
    clash = spark.createDataFrame([(i, t, "r", 7, "p", "g") for i, t in rows], "doc_id long, text string, row string, block int, pairs string, groups string")
    got = alignment.align(clash, keep_groups=True)
    assert got.columns == ["doc_id", "text", "row", "block", "pairs", *COLUMNS, "groups"]
    want = sorted((repr((i, t)), w) for (i, t), w in zip(rows, brute([t for _, t in rows])))
    out = got.collect()
    assert sorted((repr((r.doc_id, r.text)), tuple(r[c] for c in COLUMNS)) for r in out) == want
    assert {(r.row, r.block, r.pairs) for r in out} == {("r", 7, "p")}
    for r in out:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_long_text_and_empty_table(odd, empty):
    rows = alignment.align(odd, keep_text=False).collect()
    assert len(rows) == odd.count() and all(r.score == "s" for r in rows)
    assert alignment.align(empty).collect() == []


@pytest.mark.parametrize("seed", range(60))
def test_cuts_equal_common_ends(seed):
    rnd = random.Random(seed)
    end = rnd.randint(1, 400)
    keep = rnd.choice([0.1, 0.5, 0.9, 1.0])
    a = sorted({e for e in range(1, end) if rnd.random() < keep} | {end})
    b = sorted({e for e in a if rnd.random() < 0.95} | {e for e in range(1, end) if rnd.random() < 0.1} | {end})
    both = sorted(set(a) & set(b))
    assert alignment.cuts(a, b) == ([a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both])


def test_tokens_of_both_libraries_are_the_same():
    library, (a, _) = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), alignment.sides(alignment.BYTE_BPE, alignment.RANKS, alignment.PIECES)
    library.encode_special_tokens = True
    rnd = random.Random(3)
    alphabet = ["a", "Z", " ", "  ", "\n", "\t", "'s", "9", "é", "<|endoftext|>", "!!", "日本", "word", " the", "가", "ア"]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    assert a.encode(made) == [library.encode(" " + t, add_special_tokens=False).ids for t in made]
