"""Quality rules by distribution divergence, in DataFrame operations only.

A document is described by two histograms: of its characters over eight classes, and of its
words over the common words of the corpus' languages (and one bin for all other words).  Common
are the `TOP` words of a language that most of its documents hold, at least `HELD` of them; they are
counted over all documents.  The references are the histograms of each language's documents, summed
over those that pass the base rule; a second round leaves out the documents that the first
references reject.  A language is what documents name as theirs (those that name none are a group
of their own), and has a reference if `LANGUAGE_SHARE` of all documents name it: at most 50 do.
A document whose Jensen-Shannon distance to its nearest reference is above a threshold is
rejected.  A short text says little about a distribution: each distance counts only from a
minimum length on, and its threshold falls with the root of the length.

Contract of `judge`: returns every row and column of docs with the struct `rules` (n_words,
word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
word_distance, kept), which replaces a column of that name.  A null or empty text has no
words, fails the base rule and has null distances; repeated rows are judged each; an empty
table gives an empty table; with no reference the distances are null and only the base rule
counts.  What a document names as its language decides nothing: it is held against every
reference.  A text of which less than `KNOWN` are common words of any language is in none of them, and
its words are not judged, only its characters; of one mostly of letters that aren't Latin, the
base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACES, materialise, query, table, text_of

TOP, HELD, LANGUAGE_SHARE, KNOWN = 16, 0.1, 0.02, 0.1

# Character classes, as regular expressions know them.  Two more classes are
# white space, whose count is what words leave, and the rest.
CLASSES = ["a-z", "A-Z", "0-9", ".,;:?'\"()\\-", "!", "#*$%&|<>"]
SYMBOLS = CLASSES.index("#*$%&|<>")

PLACES = 20  # bits of a window's place beside its shortened hash

MIN_WORDS, MAX_REPEATED = 50, 50  # base rule: words, and per cent of words in repeated windows
# From a length on, the most distance: a + b / sqrt(length), by characters and by words.
CHAR_LIMIT = (200, 0.06, 3.2)
WORD_LIMIT = (50, 0.26, 0.7)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in an expression many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""
    n = F.size(words)
    windows = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1), F.greatest(n - 2, F.lit(0)),
    )

    def inside(places: Column) -> Column:
        return F.size(F.array_distinct(F.concat(places, F.transform(places, lambda i: i + 1), F.transform(places, lambda i: i + 2))))

    def by_rows(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(ranked: Column) -> Column:
            twice = F.filter(
                ranked,
                lambda s, k: (s.h == F.get(ranked, k + 1).h).eqNullSafe(True) | (s.h == F.get(ranked, k - 1).h).eqNullSafe(True),
            )
            return let(F.transform(twice, lambda s: s.i), inside)

        return let(placed, of)

    def by_numbers(found: Column) -> Column:
        """The same by sorting plain numbers: a hash without its lowest bits, and the place in these."""
        placed = F.sort_array(F.transform(found, lambda h, i: h.bitwiseAND(-1 << PLACES).bitwiseOR(i)))

        def of(ranked: Column) -> Column:
            def same(x: Column, at: Column) -> Column:  # all but the place
                return (F.shiftright(x, PLACES) == F.shiftright(F.get(ranked, at), PLACES)).eqNullSafe(True)

            twice = F.filter(ranked, lambda x, k: same(x, k + 1) | same(x, k - 1))
            return let(F.transform(twice, lambda x: x.bitwiseAND((1 << PLACES) - 1).cast("int")), inside)

        return let(placed, of)

    def covered(found: Column, distinct: Column) -> Column:
        """Numbers do where there is room for the places, and no two hashes are the same when shortened."""
        short = F.size(F.array_distinct(F.transform(found, lambda h: F.shiftright(h, PLACES))))
        fits = F.when(F.size(found) <= 1 << PLACES, short == distinct).otherwise(False)
        return F.when(fits, by_numbers(found)).otherwise(by_rows(found))

    return let(
        windows,
        lambda found: let(
            F.size(F.array_distinct(found)),
            lambda distinct: F.when(distinct == F.size(found), 0).otherwise(covered(found, distinct)),
        ),
    )


def _plain(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".,;:!?")))


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Of each language with a reference the words that most of its documents hold.

    A document has so many words, so that few can be held by a tenth of all; the rest is left out
    before any are ranked.
    """
    # The words are not split only to be counted: the first ones tell.
    enough = f"^[{SPACES}]*+(?:[^{SPACES}]++[{SPACES}]++){{{MIN_WORDS - 1}}}[^{SPACES}]"
    known = docs.where(text_of(text).rlike(enough)).select(_language(lang).alias("lang"), text_of(text).alias("text"))
    sizes = {r.lang: r["count"] for r in _shares(known).collect()}  # at most 1 / LANGUAGE_SHARE rows
    if not sizes:
        return {}
    held = F.array_distinct(F.transform(F.array_distinct(words_of(F.col("text"))), _plain))
    each = known.where(F.col("lang").isin(*sizes)).select("lang", F.explode(held).alias("word"))
    least = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, HELD * n)])[F.col("lang")]
    counts = each.groupBy("lang", "word").count().where((F.col("count") >= least) & (F.col("word") != ""))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    out: dict[str, list[str]] = {k: [] for k in sizes}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= TOP).orderBy("lang", "rank").collect():
        out[r.lang].append(r.word)
    return out


def _shares(known: DataFrame) -> DataFrame:
    """The languages that enough documents name."""
    counts = known.groupBy("lang").count()
    total = counts.agg(F.sum("count").alias("n"))
    return counts.where(F.col("count") >= LANGUAGE_SHARE * total.scalar())


def _word_counts(words: Column, bins: list[str]) -> Column:
    """Counts of the common words, in the order of bins, which ascend, and of all others."""
    if not bins:
        return F.array(F.size(words))
    common = F.filter(F.transform(words, _plain), lambda w: w.isin(*bins))

    def counted(found: Column) -> Column:
        """Lengths of the runs of sorted words, of which each bin is one more."""
        def runs(ranked: Column) -> Column:
            last = F.transform(ranked, lambda w, i: F.when(~w.eqNullSafe(F.get(ranked, i + 1)), i))
            return let(F.array_compact(last), lambda at: F.transform(at, lambda i, k: i - F.coalesce(F.get(at, k - 1), F.lit(-1)) - 1))

        return let(F.sort_array(F.concat(found, F.array(*map(F.lit, bins)))), runs)

    return let(common, lambda c: F.concat(counted(c), F.array(F.size(words) - F.size(c))))


def _char_counts(text: Column, word_chars: Column) -> Column:
    """Counts of CLASSES, white space and the rest; most of a text are of the first class or white space."""
    def counts(left: Column) -> Column:
        return F.array(word_chars - F.length(left), *[F.length(F.regexp_replace(left, f"[^{c}]+", "")) for c in CLASSES[1:]])

    return let(
        let(F.regexp_replace(text, f"[{CLASSES[0]}{SPACES}]+", ""), counts),
        lambda c: F.concat(
            c, F.array(F.length(text) - word_chars, word_chars - F.aggregate(c, F.lit(0), lambda a, x: a + x))
        ),
    )


def _foreign(text: Column, rest: Column, word_chars: Column) -> Column:
    """Whether most of the characters are letters of another script; they are counted in `rest`, with symbols."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}]|\\p{IsLatin}", ""))
    return F.when(2 * rest > word_chars, 2 * letters > word_chars).otherwise(False)


def _language(lang: str) -> Column:
    """The language without its region; empty where none is named."""
    found = F.lower(F.regexp_extract(F.col(lang).cast("string"), "^[A-Za-z]*", 0))
    return F.when(found == "und", "").otherwise(F.coalesce(found, F.lit("")))


def measure(docs: DataFrame, bins: list[str], text: str = "text") -> DataFrame:
    """docs with the struct `__measured`: the base counts and both histograms."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            _word_counts(words, bins).alias("words"),
        )

    return docs.withColumn("__measured", let(words_of(t), of_words)).withColumn(
        "__measured",
        let(
            F.struct("__measured.*", _char_counts(t, F.col("__measured.word_chars")).alias("chars")),
            lambda m: F.struct(
                m.n_words.alias("n_words"), m.word_chars.cast("long").alias("word_chars"),
                m.n_repeat_words.alias("n_repeat_words"), m.words.alias("words"), m.chars.alias("chars"),
                F.get(m.chars, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                _foreign(t, F.get(m.chars, F.lit(len(CLASSES) + 1)), m.word_chars).alias("foreign"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ),
    )


def base_failed(m: str = "__measured") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MAX_REPEATED * F.col(f"{m}.n_words")
    )


def references(measured: DataFrame, languages: dict[str, list[str]], n_bins: int, lang: str = "lang") -> list[tuple[list[float], list[float]]]:
    """Of each language the character and word distribution of its documents."""
    def sums(field: str, n: int) -> list[Column]:
        return [F.sum(F.get(F.col(f"__measured.{field}"), F.lit(i)).cast("long")).alias(f"{field}{i}") for i in range(n)]

    if not languages:
        return []
    n_chars = len(CLASSES) + 2
    known = measured.withColumn("__language", _language(lang)).where(F.col("__language").isin(*languages) & ~F.col("__measured.foreign"))
    rows = known.groupBy("__language").agg(*sums("chars", n_chars), *sums("words", n_bins + 1)).collect()
    out = []
    for row in sorted(rows, key=lambda r: r[0]):
        chars, words = row[1 : 1 + n_chars], row[1 + n_chars :]
        out.append(([x / sum(chars) for x in chars], [x / sum(words) for x in words]))
    return out


def shares(counts: Column) -> Column:
    """The bins of a histogram that hold anything, with their shares; null if none does."""
    held = F.filter(F.transform(counts, lambda c, i: F.struct(i.alias("i"), c.alias("n"))), lambda s: s.n > 0)
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return let(
        total.cast("double"),
        lambda t: F.when(t > 0, F.transform(held, lambda s: F.struct(s.i.alias("i"), (s.n / t).alias("p")))),
    )


def apart(held: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of shares to a distribution.

    A bin that the shares lack adds what the distribution has in it, so that only bins they hold are visited.
    """
    bins = F.array(*map(F.lit, reference))

    def term(p: Column, q: Column) -> Column:
        both = p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)) - q
        return F.when(q > 0, both).otherwise(p)

    total = F.aggregate(held, F.lit(float(sum(reference))), lambda a, s: a + term(s.p, F.get(bins, s.i)))
    return F.when(held.isNotNull(), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram of counts to a distribution."""
    return let(shares(counts), lambda held: apart(held, reference))


def verdicts(measured: DataFrame, known: list[tuple[list[float], list[float]]]) -> DataFrame:
    """measured with both distances and the verdict, against the references."""
    def nearest(field: str, which: int) -> Column:
        if not known:
            return F.lit(None).cast("double")
        return let(shares(F.col(f"__measured.{field}")), lambda held: F.array_min(F.array(*[apart(held, r[which]) for r in known])))

    def off(length: Column, found: str, limit: tuple[int, float, float]) -> Column:
        least, a, b = limit
        return F.coalesce((length >= least) & (F.col(found) > a + b / F.sqrt(length)), F.lit(False))

    n_chars = F.aggregate("__measured.chars", F.lit(0), lambda a, x: a + x)
    near = measured.select("*", nearest("chars", 0).alias("__chars_off"), nearest("words", 1).alias("__words_off"))
    n_words = F.col("__measured.n_words")
    in_known = F.element_at("__measured.words", -1) <= (1 - KNOWN) * n_words
    rejected = off(n_chars, "__chars_off", CHAR_LIMIT) | (in_known & off(n_words, "__words_off", WORD_LIMIT))
    return near.withColumn("__kept", ~base_failed() & ~(~F.col("__measured.foreign") & rejected))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """The texts' measures are written once, as the references need all of them."""
    docs = docs.drop("rules")
    languages = common_words(docs, text, lang)
    bins = sorted({w for words in languages.values() for w in words})
    measured = measure(docs, bins, text)
    measured = materialise(measured if keep_text else measured.drop(text), "measured")
    first = references(measured.where(~base_failed()), languages, len(bins), lang)
    known = references(verdicts(measured, first).where("__kept"), languages, len(bins), lang)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = F.struct(
        *[F.col(f"__measured.{c}").alias(c) for c in counts],
        base_failed().alias("base_failed"), F.col("__chars_off").alias("char_distance"), F.col("__words_off").alias("word_distance"),
        F.col("__kept").alias("kept"),
    )
    return verdicts(measured, known).select(*[f"`{c}`" for c in measured.columns if c != "__measured"], rules.alias("rules"))


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rules = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, keep_text=False).select("doc_id", *[f"rules.{r}" for r in rules])
