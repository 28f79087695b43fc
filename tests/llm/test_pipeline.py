"""The pipeline, stage by stage, against brute force on each stage's own input."""

import ast
import hashlib
from pathlib import Path

import numpy as np
import pytest
from test_duplicates import brute_components, sets_of
from test_models import brute_rules

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import byte_bpe, decontamination

ROOT = Path(__file__).parent.parent.parent


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.materialise(stage(spark, docs, small), name)
        out.append((docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    for _, rows, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows
        assert all(r.n_chars == len(r.text) for r in rows)


def test_quality_stage(stages):
    before, after, _ = stages[0]
    kept = {r.doc_id for r in after}
    assert not any(brute_rules(r.text)[-1] for r in before if r.doc_id in kept)
    assert len(kept) > 0.8 * sum(not brute_rules(r.text)[-1] for r in before)


def test_near_dedup_stage(stages):
    before, after, _ = stages[2]
    want = brute_components(sets_of({r.doc_id: r.text for r in before}))
    assert {r.doc_id for r in after} == {i for i, c in want.items() if i == c}


def test_decontamination_stage(spark, small, stages):
    before, after, _ = stages[3]
    items = [decontamination.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    held = {r.doc_id for r in before if any(x in decontamination.plain(r.text) for x in items)}
    assert not held & kept and len(kept) >= len(before) - 2 * len(held) - 1


def test_encoding_stage(stages):
    before, after, _ = stages[4]
    enc = byte_bpe.encoding(byte_bpe.MULTI, corpus_pipeline.byte_bpe.public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_equals_the_stages(spark, small, stages):
    rows = entry.queries()["pipeline"](spark, small).collect()
    key = lambda r: (r.doc_id, r.n_tokens, r.decoded_sha256)
    assert sorted(map(key, rows)) == sorted(map(key, stages[-1][1]))


def test_every_stage_takes_odd_rows(spark, small, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == [], name
        rows = stage(spark, odd, small).collect()
        assert len(rows) <= odd.count(), name
        assert name == "quality_rules" or {1, 4, 6, 9} <= {r.doc_id for r in rows}, name


def test_nothing_else_imports_the_folder():
    for path in [*ROOT.glob("tidewatch/**/*.py"), *ROOT.glob("*.py"), *ROOT.glob("tests/*.py")]:
        if path.parent.name == "llm" or path.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
