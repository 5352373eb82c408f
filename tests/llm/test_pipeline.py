"""The pipeline: each stage on what the one before it kept, held against plain Python."""

from __future__ import annotations

from loadcast.llm import pipeline, toxicity
from loadcast.llm.common import stored, tables
from loadcast.llm.registry import ORACLE, QUERIES
from tests.conftest import SMOKE_DIR
from tests.llm.test_jaccard import brute as near
from tests.llm.test_lines import brute as clean
from tests.llm.test_packing import valid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE_DIR}/labels.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram jaccard join", "source mixing", "best-fit packing"]

    calm = stored(stages["toxicity"](spark, docs, SMOKE_DIR))
    scorer = toxicity.Scorer(toxicity.fit_on(docs, labels.select("doc_id", "toxic")))
    edge = 0.8472978603872034  # the logit of the threshold
    assert rows_of(calm) == [r for r in rows_of(docs) if scorer.logit(r[1]) < edge]

    lean = stored(stages["line dedup"](spark, calm, SMOKE_DIR))
    assert rows_of(lean) == sorted(clean(rows_of(calm), pipeline.LINE_RATIO, pipeline.LINE_LEAST_TEXTS), key=str)

    single = stored(stages["n-gram jaccard join"](spark, lean, SMOKE_DIR))
    rows = sorted(rows_of(lean))
    _, label = near(rows)
    assert rows_of(single) == sorted((rows[k] for k in sorted(set(label))), key=str)

    mixed = stored(stages["source mixing"](spark, single, SMOKE_DIR))
    assert all(f.columns == COLUMNS for f in (calm, lean, single, mixed))
    assert set(rows_of(mixed)) <= set(rows_of(single))
    packed = stages["best-fit packing"](spark, mixed, SMOKE_DIR).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()
    assert valid(packed, 2048) * 2048 * 0.9 < sum(r.length for r in packed)


def test_registered_queries(spark):
    assert {q.split("_")[0] for q in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(ORACLE) <= set(QUERIES)


def test_whole_run_and_its_tables(spark):
    before = tables()
    got = pipeline.run(spark, SMOKE_DIR)
    assert valid(got.collect(), 2048) and got.columns[0] == "doc_id"
    left = [t for t in tables() if t not in before]
    assert 0 < len(left) < 8  # those of the last stage and what it reads; a run writes some twenty


def test_empty_and_awkward_documents(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("few", [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one two", None, None, 7), (3, "x " * 3000, "en", "s", 6000)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = pipeline.run(spark, folder).collect()
        assert len(out) == 0 if name == "none" else {r.doc_id for r in out} <= {None, 1, 2, 3} and out
