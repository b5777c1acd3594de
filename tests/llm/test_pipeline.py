import importlib
import random
import sys
from collections import Counter

import llm_fixtures
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelake.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("corpus")
    items = [(k, llm_fixtures.sentence(rng, 25)) for k in range(6)]
    common = "Here is a line that many of the documents share, to the last letter."
    rows, labels = [], []
    for k in range(500):
        text = llm_fixtures.sentence(rng, 40)
        if k % 10 == 3:
            text += " zorgle fropish zorgles"
        if k % 25 == 4:
            text += "\n" + common
        labels.append((k, 1, int(k % 10 == 3)))
        rows.append((k, text, "en", f"s{k % 4}"))
    rows += [(600 + k, rows[k][1].replace("\n" + common, "") if k else rows[0][1], "en", "s1") for k in (0, 7, 11)]
    rows += [(700 + k, f"{llm_fixtures.sentence(rng, 10)} {items[k][1]} {llm_fixtures.sentence(rng, 5)}", "en", "s2") for k in range(6)]
    rows += [(800, None, None, None), (801, "", "en", "s0"), (802, "short", "en", None)]
    llm_fixtures.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, common


def test_stages(spark, corpus):
    folder, rows, common = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == columns
        out = corpus_pipeline.materialize(out, "stage")
        seen[name] = {r.doc_id: r for r in out.collect()}
        docs = out
    toxic = {k for k in range(500) if k % 10 == 3}
    everyone = {i for i, *_ in rows}
    assert set(seen["toxicity"]) == everyone - toxic
    lines = seen["line dedup"]
    assert set(lines) == everyone - toxic
    holders = {i for i, r in lines.items() if common in (r.text or "")}
    assert len(holders) == 1 and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in lines.values())
    assert set(seen["near dedup"]) == everyone - toxic - {600, 607, 611}
    clean = everyone - toxic - {600, 607, 611} - {700 + k for k in range(6)}
    assert set(seen["decontamination"]) == clean
    mixed = docs.collect()
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= clean and max(copies.values()) <= 2
    taken = Counter()
    target = {}
    for r in mixed:
        taken[r.source] += r["_mix_size"]
        target[r.source] = r.mix_target
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 10 for s in target)
    assert mixed[0].key == "mine-key"


def test_mixing_of_repeated_rows(spark):
    """Rows that occur a thousand times share their copies; all the others are taken as before."""
    rng = random.Random(4)
    rows = [(1, llm_fixtures.sentence(rng, 40), "en", "a")] * 3000 + [(None, llm_fixtures.sentence(rng, 25), "en", "a")] * 1500
    rows += [(10 + k, llm_fixtures.sentence(rng, rng.randint(5, 60)), "en", "ab"[k % 2]) for k in range(600)] + [(5, None, None, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = corpus_pipeline.materialize(corpus_pipeline.mixing(spark, docs, ""), "mixed")
    assert out.columns == [*docs.columns, "mix_size", "mix_target", "mix_copy"]
    taken, target = Counter(), {}
    for r in out.collect():
        taken[r.source] += r.mix_size
        target[r.source] = r.mix_target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target) and set(target) == {"a", "b"}
    copies = Counter(r.doc_id for r in out.collect())
    assert copies[1] <= 6000 and copies[None] <= 3000 and copies[1] > 100
    again = Counter(tuple(r) for r in corpus_pipeline.mixing(spark, docs.repartition(3), "").collect())
    assert again == Counter(tuple(r) for r in out.collect())


def test_run_and_registry(spark, corpus):
    folder, *_ = corpus
    out = corpus_pipeline.materialize(corpus_pipeline.run(spark, folder), "out")
    assert out.count() > 500
    # every stage takes the pipeline's own output
    for name, stage in corpus_pipeline.STAGES:
        again = stage(spark, out, folder)
        assert name == "mixing" or again.columns == out.columns
        assert again.count() > 300
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{k}_" for k in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty_corpus(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_without_the_text_operators(monkeypatch):
    """The rest still imports when this subpackage is gone."""
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "wavelake.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert "onset_fraction" in alone.queries() and not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
    assert F is not None
