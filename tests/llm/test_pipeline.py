"""The pipeline's stages, and the entry with and without the corpus modules."""

from __future__ import annotations

import os
import subprocess
import sys

import brute
import compare
import pytest

import corpus_pipeline
from panelscope.llm import lines, queries, toxicity
from panelscope.llm.common import text_key
from panelscope.session import write_scratch

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_operator_is_a_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(queries.llm_queries()) <= names


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES:
        held.append(write_scratch(stage(spark, held[-1], sf), "stage"))
        if len(held) <= len(corpus_pipeline.STAGES):
            assert held[-1].columns == columns
    start, calm, cut, single, clean, packed = [
        {r.doc_id: r for r in t.collect()} if "text" in t.columns else t.collect() for t in held]

    # toxicity: the predicted ones go, the others are as they were
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert set(calm) == {r.doc_id for r in scored if not r.predicted}
    assert all(start[i] == r for i, r in calm.items())

    # lines: none is like another one, and only lines go
    assert set(cut) <= set(calm)
    texts = [x for r in cut.values() for _, x in brute.lines(r.text, lines.MIN_WORDS)]
    assert len(set(texts)) == len(texts)
    for i, r in cut.items():
        before = iter((calm[i].text or "").split("\n"))
        assert all(any(x == y for y in before) for x in (r.text or "").split("\n"))
        assert r.n_chars == len(r.text or "")

    # near duplicates: one of each class
    listed = sorted(cut.values(), key=lambda r: r.doc_id)
    class_of = brute.classes([brute.word_shingles(r.text) for r in listed])
    first = {}
    for r, c in zip(listed, class_of):
        first.setdefault(c, r.doc_id)
    assert set(single) == set(first.values()) and all(cut[i] == r for i, r in single.items())

    # contamination: no item is left in any text
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {i for i, r in single.items() if any(x in (r.text or "") for x in items)}
    assert found and not found & set(clean) and set(single) - set(clean) >= found
    assert len(set(single) - set(clean)) <= len(found) + 3

    # packing: every document once
    whole = {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert set(whole) == set(clean)
    assert whole == {r.doc_id: r.doc_tokens for r in packed}


def test_run_is_the_stages(spark, sf_small):
    got = corpus_pipeline.run(spark, sf_small)
    assert got.count() > 100 and "ids_crc32" in got.columns


def test_repeated_rows_and_keys(spark, docs):
    """text_key tells rows of one id apart, null and empty alike."""
    keys = docs.select("doc_id", "text", text_key().alias("k")).where("doc_id in (5, 300, 301)").collect()
    assert len({r.k for r in keys if r.doc_id == 5}) == 2
    assert len({r.k for r in keys if r.doc_id != 5}) == 1


def test_entry_without_the_corpus_modules(tmp_path):
    """Without corpus_pipeline.py and llm/ the entry has all other queries; other errors are not hidden."""
    for name in ("__spark_entry__.py", "oracle_queries.py"):
        (tmp_path / name).write_text(open(f"{ROOT}/{name}").read())
    (tmp_path / "panelscope").mkdir()
    for name in os.listdir(f"{ROOT}/panelscope"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/panelscope/{name}", tmp_path / "panelscope" / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"

    def run():
        return subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                              env=os.environ | {"PYTHONPATH": str(tmp_path)})

    done = run()
    assert done.returncode == 0, done.stderr
    n, ops, pipeline = done.stdout.split()
    assert int(n) >= 105 and (ops, pipeline) == ("False", "False")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_here\n")
    assert "no_such_module_here" in run().stderr


@pytest.mark.parametrize("name", sorted(queries.llm_oracle_sql()))
def test_whole_tables_match_reference_sql(spark, sf, name):
    sql = queries.llm_oracle_sql()[name]
    assert compare.differences(queries.llm_queries()[name](spark, sf), compare.connect(sf), sql) is None


def test_pipeline_over_awkward_and_empty_documents(spark, docs, empty, labels, items, tmp_path):
    for name, table in (("some", docs), ("none", empty)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/some")
    ids = {r.doc_id for r in packed.collect()}
    assert {300, 301, 402} <= ids and not {201, 239} & ids
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
