"""The corpus pipeline: every stage on awkward tables, and each stage's decisions on its own input."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("pointloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pointloom.llm import quality_rules
from pointloom.session import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_entities long, row string, Attempts string, h long, kept string, f_spans string"


def hot_rows():
    """Nulls, empty and long texts, an id and a text of a third of all rows, near copies, benchmark passages, personal data, clashing names."""
    words = [f"word{k}" for k in range(300)]
    plain = " ".join(words)
    rows = [(7, plain)] * 40 + [(k, plain) for k in range(100, 140)] + [(200 + k, " ".join(words[:150] + [f"x{k}"] + words[151:])) for k in range(5)]
    rows += [(k, " ".join(f"own{k}of{j}" for j in range(80))) for k in range(300, 330)] + [(None, None), (None, plain), (1, None), (2, ""), (3, " \n "), (4, "short")]
    rows += [(400, " ".join(f"b{j}" for j in range(70))), (401, "A mail to jane.roe@mail.com from Mrs Jane Roe " + " ".join(f"c{j}" for j in range(70)))]
    rows += [(500, " ".join(f"long{j}" for j in range(60_000)))]
    return [(i, t, "en", "s", len(t) if t else None, 5, "r", "a", 1, "k", "f") for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables like sf_dir."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(hot_rows(), SCHEMA).repartition(6).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(300 + k, 1, 0) for k in range(20)] + [(2, 0, 0), (None, 1, 0), (300, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("i1", " ".join(f"b{j}" for j in range(20, 40))), ("i2", None), (None, "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, folder), "stage")
        assert after.schema.simpleString() == before.schema.simpleString(), name
        sizes[name] = after.count()
        if name == "quality":
            want = Counter(r.doc_id for r in before.collect() if len((r.text or "").split()) >= 50)
            assert Counter(r.doc_id for r in after.collect()) == want
        if name == "near_duplicates":
            left = Counter(r.doc_id for r in after.collect())
            assert left[7] == 1 and not any(left[k] for k in range(100, 140)) and not left[None] and all(left[k] == 1 for k in (*range(300, 330), 400, 401, 500))
        if name == "decontamination":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
            assert gone == {400}
        if name == "surrogates":
            text = {r.doc_id: r.text for r in after.collect()}
            assert {r.doc_id for r in before.collect() if r.text != text[r.doc_id]} == {401}
            assert "jane.roe" not in text[401] and "Jane Roe" not in text[401] and re.match(r"A mail to [a-z]{4}\.[a-z]{3}@", text[401])
            assert all(r.n_chars == len(r.text) and r.n_entities == 5 for r in after.collect())
        before = after
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, before, folder).collect()
    filled = defaultdict(int)
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.collect()} and max(filled.values()) <= 2048
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(total.values())
    whole = corpus_pipeline.run(spark, folder).collect()
    facts = lambda rows: Counter((p.doc_id, p.doc_tokens) for p in rows)
    assert set(facts(whole)) == set(facts(pieces)) and sum(p.length for p in whole) == sum(p.length for p in pieces)


def test_stages_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs.where("doc_id between 300 and 305"), str(tmp_path))
        assert kept.columns == docs.columns and kept.count() == 6, name


def test_without_labels_only_the_base_rule_holds(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.read.parquet(f"{folder}/labels.parquet").limit(0)
    rules = quality_rules.learn(docs, none)
    assert rules.rules == []
    want = Counter(r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 50)
    assert Counter(r.doc_id for r in quality_rules.kept(docs, rules).collect()) == want
