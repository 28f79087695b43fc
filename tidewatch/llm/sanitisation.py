"""Personal data by patterns, and the terms that give it away, in DataFrame operations only.

Protected entities are e-mail addresses, IP addresses, card and telephone numbers.  Removing them
is not enough where a word beside them tells which one stood there.  How much a term t tells of an
entity e is estimated from the corpus: with n texts, of which n_e hold e, n_t hold t and n_et hold
t beside e (within `CONTEXT` words), the pointwise mutual information is

    PMI(e; t) = log2(n * n_et / (n_e * n_t)),    IC(e) = log2(n / n_e)

and IC(e) - PMI(e; t) = log2(n_t / n_et) bits of e remain unknown to who reads t.  A term that
leaves at most `REMOVE_BITS` is removed, one that leaves at most `GENERALISE_BITS` is generalised
to its shape (letters a, digits 0), provided that it tells `GAIN_BITS` or more.  So much is claimed
only on evidence: in `SUPPORT` texts or more, of which copies count once, and with surroundings of
which half at least differ (the two nearest words on each side, but for t), so that near copies
of one passage give nothing away.  A disclosing term is marked in all texts that hold it.

Texts are numbered by their SHA-256, entities and terms never pass the driver, and no join is
forced: candidates are few and Catalyst sees their size.

Contract of `sanitise`: returns every row and column of docs (the text only with `keep_text`) with
`found` (struct of the arrays email, ip, card, phone and term, each of struct<start, end> in code
points, end exclusive; term has `term` and `action` too) and, with `keep_text`, `sanitised`, the text
with entities as `<KIND>` and terms removed or generalised; both replace columns of those names.
Terms that overlap an entity are left out.  A null or empty text has nothing; repeated rows are
each given the same; an empty table gives an empty table.  Further columns ride along in one
struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise, query, table, text_of
from .quality_rules import let

# The patterns of the contract, told so that no text makes them slow or deep: repetitions don't give
# back, and one doesn't start inside a stretch of characters on which it has failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)"

RUN = r"[\p{L}\p{M}\p{N}]++"  # a term is a run of letters and digits, in lower case
GAP = r"[^\p{L}\p{M}\p{N}]+"
CONTEXT, SPAN = 8, 160  # words beside an entity, looked for among so many characters
SHORTEST = 3
SUPPORT, GAIN_BITS, REMOVE_BITS, GENERALISE_BITS = 3, 3.0, 0.25, 1.0


# ---------------------------------------------------------------- entities


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right doubled, digit sum by 10."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return let(_digits(found), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(found)).between(8, 15)


def running(values: Column, block: int = 256) -> Column:
    """Running totals of an array, by blocks, as an array that grows is copied at every step."""
    def within(part: Column) -> Column:
        add = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
        return F.aggregate(part, F.array().cast("array<int>"), add)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda k: within(F.slice(values, k * block + 1, F.lit(block)))
    )
    return let(
        blocks,
        lambda done: let(
            within(F.transform(done, lambda part: F.element_at(part, -1))),
            lambda sums: F.flatten(F.transform(
                done, lambda part, k: F.transform(part, lambda x: x + F.when(k == 0, 0).otherwise(F.get(sums, k - 1)))
            )),
        ),
    )


def _places(text: Column, pattern: str, keep, made) -> Column:
    """made(match, start, pieces, number) of each leftmost match that keep() holds for.

    The pieces between the matches tell where these start.
    """
    def walk(found: Column, parts: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))

        def placed(ends: Column) -> Column:
            every = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
            return F.transform(
                F.filter(every, lambda s: keep(s.m)), lambda s: made(s.m, F.get(ends, s.i) - F.length(s.m), parts, s.i)
            )

        return let(running(steps), placed)

    empty = F.transform(F.array().cast("array<string>"), lambda m, i: made(m, i, F.array(m), i))
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern), lambda parts: walk(found, parts))),
    )


def _words(context: Column) -> Column:
    return F.filter(F.transform(F.split(context, GAP), lambda w: F.lower(w)), lambda w: w != "")


def _nearest(words: Column, piece: Column) -> Column:
    """The first words; the last one is left out where the piece goes on, as it may be cut in two."""
    whole = lambda w: F.when(F.length(piece) > SPAN, F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
    return let(words, lambda w: F.slice(whole(w), 1, CONTEXT))


def _entities_of(kind: str) -> Callable[[Column], Column]:
    def made(m: Column, start: Column, parts: Column, i: Column) -> Column:
        front, back = F.get(parts, i), F.get(parts, i + 1)
        return F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"),
            (F.lower(m) if kind in ("email", "ip") else _digits(m)).alias("entity"),
            _nearest(F.reverse(_words(F.substring(front, -SPAN, SPAN))), front).alias("before"),
            _nearest(_words(F.substring(back, 1, SPAN)), back).alias("behind"),
        )

    return lambda text: _places(text, PATTERNS[kind], lambda m: valid(kind, m), made)


def entities(text: Column) -> Column:
    """A struct with, of each kind, an array of (start, end, entity, before, behind), the nearest words first.

    A text without the character that a kind needs is not searched for it.
    """
    sign = {"email": text.contains("@"), "phone": text.contains("+")}
    shown = {k: F.when(sign.get(k, text.rlike("[0-9]")), text).otherwise("") for k in KINDS}
    return F.struct(*[let(shown[k], _entities_of(k)).alias(k) for k in KINDS])


# ---------------------------------------------------------------- disclosure


def candidates(mentions: DataFrame) -> DataFrame:
    """(entity, term, n_et) with enough evidence, of mentions (text_key, entity, before, behind)."""
    near = F.concat(F.slice("before", 1, 2), F.slice("behind", 1, 2))
    beside = mentions.select(
        "text_key", "entity", near.alias("near"), F.explode(F.array_distinct(F.concat("before", "behind"))).alias("term")
    ).where(F.length("term") >= SHORTEST)
    told = beside.select("entity", "term", "text_key", F.xxhash64(F.array_remove("near", F.col("term"))).alias("around"))
    counts = told.groupBy("entity", "term").agg(
        F.countDistinct("text_key").alias("n_et"), F.countDistinct("around").alias("n_around")
    )
    counts = counts.where((F.col("n_et") >= SUPPORT) & (2 * F.col("n_around") >= F.col("n_et")))
    # A term is in as many texts at least as hold it beside any entity: common words need no further count.
    least = told.groupBy("term").agg(F.countDistinct("text_key").alias("n_beside"))
    possible = F.log2(F.col("n_beside") / F.col("n_et")) <= GENERALISE_BITS
    return counts.join(least, "term").where(possible).select("entity", "term", "n_et")


def terms_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, term) of the given terms in each text of docs (text_key, text)."""
    runs = F.array_distinct(F.transform(F.split("text", GAP), lambda w: F.lower(w)))
    return docs.select("text_key", F.explode(runs).alias("term")).join(terms.select("term"), "term", "left_semi")


def disclosing(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(term, bits_left, action) of the terms that give an entity away."""
    pairs = materialise(candidates(mentions), "candidates")
    n = docs.select("text_key").distinct().agg(F.count("*").alias("n"))
    n_e = mentions.groupBy("entity").agg(F.countDistinct("text_key").alias("n_e"))
    # Written, as what docs are joined with must have a size that Spark knows before it plans the join.
    held = terms_of(docs, materialise(pairs.select("term").distinct(), "candidate_terms"))
    n_t = held.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    graded = pairs.join(n_e, "entity").join(n_t, "term").withColumn("n", n.scalar())
    left = F.log2(F.col("n_t") / F.col("n_et"))
    gain = F.log2(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    worst = graded.where((gain >= GAIN_BITS) & (left <= GENERALISE_BITS)).groupBy("term").agg(F.min(left).alias("bits_left"))
    return worst.withColumn("action", F.when(F.col("bits_left") <= REMOVE_BITS, "remove").otherwise("generalise"))


def marks(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, term) with the places of the disclosing terms in each text that holds any."""
    held = terms_of(docs, terms).distinct().join(terms, "term")
    of_text = held.groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions"))
    texts = docs.join(materialise(of_text, "texts_with_terms"), "text_key").dropDuplicates(["text_key"])

    def made(m: Column, start: Column, parts: Column, i: Column) -> Column:
        return F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"), F.lower(m).alias("term"),
            F.element_at(F.col("actions"), F.lower(m)).alias("action"),
        )

    return texts.select("text_key", _places(F.col("text"), RUN, lambda m: F.map_contains_key("actions", F.lower(m)), made).alias("term"))


def sanitised(text: Column, found: Column) -> Column:
    """The text with the found places replaced; of overlapping ones the first."""
    def put(term: Column) -> Column:
        told = F.regexp_replace(F.regexp_replace(term.term, r"[\p{L}\p{M}]", "a"), r"\p{N}", "0")
        return F.when(term.action == "remove", "").otherwise(told)

    def of_kind(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s.start.alias("start"), (-s.end).alias("last"), F.lit(f"<{kind.upper()}>").alias("put"))

    all_places = F.array_sort(F.concat(
        *[F.transform(found[k], of_kind(k)) for k in KINDS],
        F.transform(found["term"], lambda s: F.struct(s.start.alias("start"), (-s.end).alias("last"), put(s).alias("put"))),
    ))

    def step(acc: Column, s: Column) -> Column:
        more = F.struct((-s["last"]).alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), s.put).alias("out"))
        return F.when(s.start >= acc.at, more).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(all_places, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    own = [c for c in docs.columns if c.lower() not in ("found", "sanitised") and c != text]
    t = text_of(f"`{text}`")
    rows = docs.select(
        F.struct(F.lit(None).cast("boolean").alias("__row"), *[F.col(f"`{c}`") for c in own]).alias("row"),
        t.alias("text"), F.col(f"`{text}`").alias("given"), F.sha2(t, 256).alias("text_key"), entities(t).alias("found"),
    )
    scanned = materialise(rows if keep_text else rows.drop("text", "given"), "scanned")
    texts = docs.select(F.sha2(t, 256).alias("text_key"), t.alias("text"))

    def mention(kind: str) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.concat(F.lit(f"{kind}:"), m.entity).alias("entity"), m.before.alias("before"), m.behind.alias("behind"))

    of_kinds = [F.transform(f"found.{k}", mention(k)) for k in KINDS]
    mentions = scanned.select("text_key", F.explode(F.concat(*of_kinds)).alias("m")).select("text_key", "m.*").distinct()
    mentions = materialise(mentions, "mentions")
    terms = materialise(disclosing(texts, mentions), "terms")
    marked = scanned.join(materialise(marks(texts, terms), "marks"), "text_key", "left")

    placed = {k: F.transform(f"found.{k}", lambda m: F.struct(m.start.alias("start"), m.end.alias("end"))) for k in KINDS}
    clear = F.filter("term", lambda s: ~F.exists(F.concat(*placed.values()), lambda e: (s.start < e.end) & (e.start < s.end)))
    clear = F.coalesce(clear, F.array().cast("array<struct<start:int,end:int,term:string,action:string>>"))
    found = F.struct(*[placed[k].alias(k) for k in KINDS], clear.alias("term"))
    out = marked.withColumn("found", found)
    back = [F.col(f"row.`{c}`") for c in own]
    if not keep_text:
        return out.select(*back, "found")
    return out.select(*back, F.col("given").alias(text), "found", sanitised(F.col("text"), F.col("found")).alias("sanitised"))


def told(found: str, kinds: list[str]) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    def one(kind: str) -> Column:
        return F.transform(f"{found}.{kind}", lambda s: F.concat_ws(":", F.lit(kind), s.start, s.end))

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


@query("op13_sanitisation")
def op13_sanitisation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitise(docs, keep_text=False).select(
        "doc_id", *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(told("found", KINDS), 256).alias("base_sha256"), told("found", [*KINDS, "term"]).alias("spans"),
    )
