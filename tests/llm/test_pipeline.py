import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from test_lines import plain  # noqa: E402
from test_simhash import groups, plain_print  # noqa: E402

from swipewatch.llm import mixing, quality  # noqa: E402
from swipewatch.llm.decontaminate import brute_force  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    return out


def test_columns(steps):
    first = steps[0][0].columns
    assert all(after.columns == first for _, after, *_ in steps[:-1]) and steps[-1][1].columns == ["doc_id", "lang", "source", "n_chars", "n_words", "posteriors", "rate", "copies", "distance"]


def test_quality_keeps_what_scores(spark, steps):
    docs, _, before, after = steps[0]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {i for i, r in before.items() if model.score(quality.statistics([(r.text or "").encode()]))[0] >= 0.3}
    assert set(after) == want and 0 < len(want) < len(before)


def test_lines(steps):
    _, _, before, after = steps[1]
    want = dict(zip(before, plain([r.text for r in before.values()], 10), strict=True))
    assert {i: r.text for i, r in after.items()} == {i: t for i, (t, _, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_of_each_group_stays(steps):
    _, _, before, after = steps[2]
    ids = sorted(before)
    assert set(after) == {ids[g] for g in groups([plain_print(before[i].text) for i in ids])} and all(after[i] == before[i] for i in after)


def test_contaminated_documents_go(spark, steps):
    _, _, before, after = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    short = [i for i in before if len(before[i].text) < 1500][:40] + [i for i in before if i not in after]
    assert all((i not in after) == brute_force(before[i].text, items)[-1] for i in short)


def test_run_gives_all_that_is_left(spark, steps):
    assert set(steps[4][3]) == set(steps[4][2]) == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}


def test_the_last_stage_meets_its_targets(steps):
    rows, targets = list(steps[4][3].values()), mixing.TARGETS
    whole = sum(r.n_words for r in rows)
    got = {d: sum(r.n_words * r.rate * r.posteriors[d] for r in rows) / whole for d in targets}
    assert all(abs(got[d] - targets[d]) <= mixing.CLOSE * 1.01 for d in targets)


def test_stages_on_an_empty_table(spark, steps):
    docs = spark.createDataFrame([], steps[0][0].schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
