"""The whole pipeline over tables with extra columns, nulls, repeats and no rows, stage by stage."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from plumbline.llm.tables import n_words

SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, kept STRING, slot INT, "
    "document STRING, key STRING, _text STRING, bin_id INT"
)


def rows_of(seed):
    rng = random.Random(seed)
    own = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    shared = own(80)
    rows = [(i, own(rng.choice([30, 60, 200, 900])), "en", rng.choice("aab")) for i in range(120)]
    base = rows[5][1] + " " + own(60)
    rows += [(200 + i, base, "en", "a") for i in range(30)]  # exact copies
    rows += [(300 + i, base + f" x{i}", "en", "b") for i in range(10)]  # near copies
    rows += [(400 + i, f"{own(10)}\n{shared}", "en", "b") for i in range(25)]  # depleted
    rows += [(500, f"{own(60)} write to jane.doe@example.org now", "en", "a")]
    rows += [(501, own(60), None, None), (None, own(60), "en", None), (502, None, "en", "a"), (503, "", None, "b")]
    rows += [(504, "same " * 200, "en", "a"), rows[0], rows[0]]
    return [(*r, None if r[1] is None else len(r[1]), "k", 7, "d", "y", "t", 1) for r in rows]


def run(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_stages_are_in_the_stated_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_dedup", "redact_personal_data", "mix_sources", "best_fit_packing"]


def test_pipeline_over_odd_rows(spark, tmp_path):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, "")
        assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
        found = docs.collect()
        docs = spark.createDataFrame(found, docs.schema)
        ids = {r["doc_id"] for r in found}
        assert {(r["kept"], r["slot"], r["document"], r["key"], r["_text"], r["bin_id"]) for r in found} == {
            ("k", 7, "d", "y", "t", 1)
        }
        if name == "quality_rules":  # short, depleted and repetitive texts go, one of each copy stays
            assert not ids & {*range(400, 425), 502, 503, 504} and {500, 501, None, 200, 229, 300} <= ids
            assert ids & set(range(120)) == {r[0] for r in rows[:120] if len(r[1].split()) >= 50}
        if name == "jaccard_dedup":
            assert {200} == ids & {*range(200, 230), *range(300, 310)}
            assert Counter(r["doc_id"] for r in found)[rows[0][0]] <= 1
            singles = ids
        if name == "redact_personal_data":
            text = next(r["text"] for r in found if r["doc_id"] == 500)
            assert "[EMAIL]" in text and "jane" not in text and ids == singles
        assert all(r["n_chars"] == len(r["text"]) for r in found)
    mixed = docs.agg({"n_chars": "count"}).first()[0]
    assert mixed == docs.count()
    out = run(spark, tmp_path, rows).collect()
    words = sum(len((r["text"] or "").split()) for r in out)
    assert words == sum(r["n"] for r in out) == docs.select(n_words(docs["text"])).groupBy().sum().first()[0]
    assert not any("jane" in (r["text"] or "") for r in out)
    longest = max(r["bin_offset"] + r["n"] for r in out if r["bin_id"])
    assert longest <= 4096 and all(r["bin_offset"] + r["n"] <= r["bin_length"] for r in out if r["bin_id"])


def test_pipeline_over_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_over_rows_that_are_all_missing(spark, name):
    rows = [(None,) * 11] * 3
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.count() in (0, 3)
