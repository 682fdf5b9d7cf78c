"""The corpus pipeline, stage by stage, on planted cases."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents of which it is known what happens to them, and that fate by doc_id."""
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, fate = [], {}

    def add(body, what):
        d = len(rows)
        rows.append((d, body, "en", "src", len(body or "")))
        fate[d] = what
        return d

    bench = [text(40), text(6)]
    labels = []
    for i in range(120):
        d = add(text(80) + (" grubnak vilebad" if i % 2 else ""), "toxic" if i % 2 else "stays")
        labels.append((d, 1, i % 2))
    base = text(150)
    add(base, "stays")
    add(base.replace(" ", "\n "), "any")  # the longer of two equal texts stays, so either may
    fate[len(rows) - 2] = "any"
    near = base.split()
    near[70] = "changed"
    add(" ".join(near), "any")
    for body in (bench[0], bench[1]):
        add(f"{text(30)} {body} {text(30)}", "contaminated")
    add(None, "any")
    add("", "any")
    at = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), fate


def test_every_stage_does_its_work(spark, planted):
    folder, fate = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {d for d, f in fate.items() if f == "toxic"}
    clean = {d for d, f in fate.items() if f == "stays"}
    assert len(toxic & left["toxicity"]) <= 2 and clean <= left["toxicity"]
    group = {d for d, f in fate.items() if f == "any"} - {max(fate), max(fate) - 1}
    assert len(group & left["exact_dedup"]) == 2 and len(group & left["near_dedup"]) == 1
    assert clean <= left["decontamination"] and not {d for d, f in fate.items() if f == "contaminated"} & left["decontamination"]
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == left["decontamination"]


def test_run_is_the_stages_in_order(spark, sf):
    out = pipeline.run(spark, sf)
    assert "batch_id" in out.columns and 0 < out.count() <= 200
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_empty_tables(spark, planted, tmp_path):
    folder, _ = planted
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
