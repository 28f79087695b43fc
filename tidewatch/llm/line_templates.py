"""Lines that recur across documents, by a fixed-depth template tree.

A line is parsed to tokens; a token with a digit is a variable field, `<*>`.  The tree's first
level is the number of tokens, the next `DEPTH` levels are the leading tokens, and a leaf
holds the lines that agree in all of these.  Within a leaf, a token is constant where enough
documents have it at that position, and a variable field elsewhere; that gives each line
its template.  A template that enough documents share and that is constant in at least half of
its tokens, and of those beyond the leading ones, is boilerplate: its lines are dropped in every document but the first, by doc_id.
A line that is the same, token for token, in `SAME_DOCS` documents recurs already; at least half
of its tokens must be without a digit.

Lines are parsed in place and written as keys: of each line its document and place, 128 bits of
its form, and 64 of its leaf.  All counts are of these.  The texts of forms are looked up only for
leaves that enough documents reach, once per distinct form, so a line that a third of all documents
share is one row, and no text is shuffled but those forms.

Contract of `drop_templates`: returns every row of docs with the lines of `text` that stay,
and with `n_lines` and `n_dropped`, which replace columns of those names.  A null text stays
null and has no lines; an empty text is one empty line.  Lines without a token, or with fewer
than `min_tokens`, always stay; the leaf of a line that is shorter than the tree is the line itself.  Rows of one doc_id are
one document; a row without doc_id is left whole and counts nowhere.  An empty table gives an
empty table.  Further columns ride along in one struct, so that none clashes with a working column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACES, blocks, materialise, nullable, query, table

DEPTH, MIN_DOCS = 3, 10
SAME_DOCS = 2  # documents that make a line recur which is the same in all of them
SHARE = 0.1  # of a leaf's documents, that have a token which is constant beyond the leading ones
FIELD = "<*>"

_DIGIT, _TOKEN = re.compile(rb"[0-9]"), re.compile(rb"[^ 0-9]*[0-9][^ ]*")


def parsed(text: str, depth: int, least: int) -> Iterator[tuple[int, int, bytes, bytes, bytes | None]]:
    """(place, tokens, form, leaf, own tokens where the form has fields) of each line with enough tokens."""
    for at, line in enumerate(text.encode().split(b"\n")):
        tokens = line.split()  # by ASCII white space
        if not tokens or len(tokens) < least:
            continue
        form, own = b" ".join(tokens), None
        if _DIGIT.search(form):
            own, form = form, _TOKEN.sub(FIELD.encode(), form)
            tokens = form.split(b" ", depth)
        yield at, len(tokens) if own is None else own.count(b" ") + 1, form, b" ".join(tokens[:depth]), own


def _leaf(n: int, lead: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b"%d " % n + lead) - (1 << 63)


def line_keys(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """(doc_id, text_key, at, n, fields, leaf_key, form_key, exact_key) of each line; docs: doc_id, text_key, text."""
    schema = docs.select("doc_id", "text_key").schema
    for name, kind in (("at", "integer"), ("n", "integer"), ("fields", "integer"), ("leaf_key", "long"), ("form_key", "binary"), ("exact_key", "binary")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                owner, rows = [], []
                for i, t in enumerate(texts):
                    for at, n, form, lead, own in parsed(t, depth, least):
                        owner.append(i)
                        exact = None if own is None else xxhash.xxh3_128_digest(own)
                        rows.append((at, n, form.count(b"<*>"), _leaf(n, lead), xxhash.xxh3_128_digest(form), exact))
                of = pa.array(owner, pa.int64())
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("text_key").take(of), *columns], names=schema.names)

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, schema)


def form_texts(docs: DataFrame, depth: int, least: int, leaves: DataFrame) -> DataFrame:
    """(form_key, form) of the forms in the given leaves, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch):
                rows = {form: (n, lead) for t in texts for _, n, form, lead, _ in parsed(t, depth, least)}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(f) for f in rows], pa.binary()),
                        pa.array([_leaf(*of) for of in rows.values()], pa.int64()), pa.array([f.decode() for f in rows], pa.string()),
                    ],
                    names=["form_key", "leaf_key", "form"],
                )

    forms = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "form_key binary, leaf_key long, form string")
    return forms.join(leaves, "leaf_key", "left_semi").groupBy("form_key").agg(F.first("form").alias("form"))


def boilerplate(forms: DataFrame, min_docs: int, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """(form_key, first): forms whose template recurs, and the first document of the template.

    forms: (form_key, form, n, docs, first).  The leading tokens that make the leaf are no sign of a
    template: half of the others must be constant too, in that share of the leaf's documents.
    """
    forms = forms.withColumn("leaf", F.concat_ws(" ", "n", F.substring_index("form", " ", depth)))
    leaves = forms.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs)
    # Written, as are the constants, so that Spark knows their size and chooses how to join.
    forms = forms.join(materialise(leaves, "leaves"), "leaf")
    least = F.when(F.col("pos") < depth, min_docs).otherwise(F.greatest(F.lit(min_docs), share * F.col("leaf_docs")))
    tokens = forms.select("leaf", "leaf_docs", "n", "form_key", "docs", F.posexplode(F.split("form", " ")).alias("pos", "token"))
    constant = tokens.groupBy("leaf", "leaf_docs", "pos", "token").agg(F.sum("docs").alias("seen"))
    constant = constant.where((F.col("seen") >= least) & (F.col("token") != FIELD)).select("leaf", "pos", "token", F.lit(True).alias("constant"))
    template = F.transform(
        F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("token")))),
        lambda t: t.token,
    )
    marked = tokens.join(materialise(constant, "constants"), ["leaf", "pos", "token"], "left").groupBy("form_key", "n").agg(
        F.array_join(template, " ").alias("template"),
        F.count("constant").alias("constants"), F.count_if(F.col("constant") & (F.col("pos") >= depth)).alias("beyond"),
    )
    marked = materialise(marked.where((2 * F.col("constants") >= F.col("n")) & (2 * F.col("beyond") >= F.col("n") - depth)), "templates")
    placed = marked.select("form_key", "template").join(forms.select("form_key", "docs", "first"), "form_key")
    recurring = placed.groupBy("template").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
    recurring = recurring.where(F.col("docs") >= min_docs).select("template", "first")
    return placed.select("form_key", "template").join(recurring, "template").select("form_key", "first")


def drop_templates(
    docs: DataFrame, text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = 1,
    same_docs: int = SAME_DOCS, share: float = SHARE,
) -> DataFrame:
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own = [c for c in order if c != text]
    docs = docs.select(
        "doc_id", F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"),
        F.struct(F.lit(None).cast("boolean").alias("__row"), *[F.col(f"`{c}`") for c in own]).alias("row"),
    )
    texts = docs.select("doc_id", "text_key", "text")
    lines = materialise(line_keys(texts, depth, min_tokens), "lines")
    forms = lines.select("doc_id", "form_key", "leaf_key", "n", "fields").distinct().groupBy("form_key", "leaf_key", "n", "fields").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first")
    )
    forms = materialise(forms, "forms")
    leaves = forms.groupBy("leaf_key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf_key")
    found = materialise(form_texts(texts, depth, min_tokens, materialise(leaves, "leaf_keys")), "form_texts")
    bad = boilerplate(forms.join(found, "form_key").select("form_key", "form", "n", "docs", "first"), min_docs, depth, share)

    plain = 2 * F.col("fields") <= F.col("n")
    alone = forms.where(((F.col("docs") >= min_docs) & plain) | ((F.col("docs") >= same_docs) & (F.col("fields") == 0))).select("form_key", "first")
    bad = materialise(bad.unionByName(alone).groupBy("form_key").agg(F.min("first").alias("first")), "boilerplate")
    exact = lines.where(F.col("exact_key").isNotNull() & plain).select("doc_id", "exact_key").distinct()
    same = exact.groupBy("exact_key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= same_docs)

    gone = lines.join(bad, "form_key").unionByName(lines.join(materialise(same.drop("docs"), "same"), "exact_key"))
    gone = gone.where("doc_id > first").groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("dropped"))
    marked = docs.join(materialise(gone, "gone"), ["doc_id", "text_key"], "left").select("row", "text", "dropped")
    marked = marked.withColumn("row", F.col("row").cast(nullable(marked.schema["row"].dataType)))
    schema = T.StructType([*marked.select("row", "text").schema.fields]).add("n_lines", "integer").add("n_dropped", "integer")
    back = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in order]
    return marked.mapInArrow(_without, schema).select(*back, "n_lines", "n_dropped")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, n_lines, n_dropped): the texts without their dropped lines."""
    for batch in batches:
        for part, texts in blocks(batch):
            kept, n_lines, n_dropped = [], [], []
            for t, null, at in zip(texts, part.column("text").is_null().to_pylist(), part.column("dropped").to_pylist()):
                own = [] if null else t.split("\n")
                at = set(at or ())
                kept.append(None if null else "\n".join([x for i, x in enumerate(own) if i not in at]) if at else t)
                n_lines.append(len(own))
                n_dropped.append(len(at))
            columns = [part.column("row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_dropped"])


ORACLE = f"""
with split as (
    select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents
), lines as (
    select doc_id, line_no, len(tokens) n, array_to_string(tokens, ' ') own,
        array_to_string(list_transform(tokens, lambda t: case when regexp_matches(t, '[0-9]') then '{FIELD}' else t end), ' ') form
    from (select doc_id, line_no, list_filter(regexp_split_to_array(line, '[{SPACES}]+'), lambda t: t <> '') tokens from split) where len(tokens) > 0
), forms as (
    select n, form, list_slice(string_split(form, ' '), 1, {DEPTH}) lead, (len(form) - len(replace(form, '{FIELD}', ''))) / {len(FIELD)} fields,
        count(distinct doc_id) docs, min(doc_id) first
    from lines group by n, form
), leaves as (
    select n, lead, sum(docs) leaf_docs from forms group by n, lead having sum(docs) >= {MIN_DOCS}
), tokens as (
    select n, lead, leaf_docs, form, docs, unnest(string_split(form, ' ')) token, generate_subscripts(string_split(form, ' '), 1) pos
    from forms join leaves using (n, lead)
), constant as (
    select n, lead, pos, token from tokens where token <> '{FIELD}' group by n, lead, leaf_docs, pos, token
    having sum(docs) >= case when pos <= {DEPTH} then {MIN_DOCS} else greatest({MIN_DOCS}, {SHARE}e0 * leaf_docs) end
), templates as (
    select t.n, t.lead, t.form, string_agg(coalesce(c.token, '{FIELD}'), ' ' order by t.pos) template
    from tokens t left join constant c on t.n = c.n and t.lead = c.lead and t.pos = c.pos and t.token = c.token group by t.n, t.lead, t.form
    having 2 * count(c.token) >= t.n and 2 * count(c.token) filter (where t.pos > {DEPTH}) >= t.n - {DEPTH}
), recurring as (
    select template, min(first) first from templates join forms using (n, lead, form) group by template having sum(docs) >= {MIN_DOCS}
), bad as (
    select n, form, min(first) first from (
        select n, form, r.first from templates join recurring r using (template)
        union all select n, form, first from forms where docs >= {MIN_DOCS} and 2 * fields <= n
        union all select n, form, first from forms where docs >= {SAME_DOCS} and fields = 0
    ) group by n, form
), same as (
    select own, min(doc_id) first from lines join forms using (n, form) where own <> form and 2 * fields <= n group by own having count(distinct doc_id) >= {SAME_DOCS}
), dropped as (
    select doc_id, line_no from lines join bad using (n, form) where doc_id > first
    union select doc_id, line_no from lines join same using (own) where doc_id > first
), kept as (
    select d.doc_id, string_agg(line, chr(10) order by d.line_no) text, count(*) n_lines
    from split d left join dropped x on d.doc_id = x.doc_id and d.line_no = x.line_no
    where x.line_no is null group by d.doc_id
)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::int n_lines,
    coalesce(len(string_split(d.text, chr(10))) - coalesce(k.n_lines, 0), 0)::int n_dropped,
    case when d.text is not null then sha256(coalesce(k.text, '')) end kept_sha256
from documents d left join kept k using (doc_id)
"""


@query("op4_line_templates", ORACLE)
def op4_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_templates(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
