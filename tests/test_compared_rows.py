"""Queries that compare reference and observed rows read Development rows only if those are the reference."""

import pytest

from swipewatch.functions import scale
from swipewatch.plans import monitor_queries as Q
from test_dealt import DAYS, write


@pytest.mark.parametrize("splits, wanted", [(("DEVELOPMENT", "VALIDATION", "OUT_OF_TIME_OOT"), "VALIDATION"), (("DEVELOPMENT", "OUT_OF_TIME_OOT"), "DEVELOPMENT")])
def test_development_rows_are_read_only_as_the_reference(spark, tmp_path, monkeypatch, splits, wanted):
    folder = write(spark, tmp_path, [(o, 7, DAYS[s]) for o, s in enumerate(splits, 1)])
    written = []
    monkeypatch.setattr(Q, "stored", lambda df: written.append(scale.stored(df)) or written[-1])
    ref, cur = Q.both(spark, folder, ("amount",))
    assert {r["split_name"] for r in ref.collect()} == {wanted} and {r["split_name"] for r in cur.collect()} == {"OUT_OF_TIME_OOT"}
    assert (written[0].where("split_name = 'DEVELOPMENT'").count(), ref.count(), cur.count()) == (0, 3, 3)
    assert {r["split_name"] for r in Q._labelled(spark, folder).collect()} == set(splits) - ({"DEVELOPMENT"} - {wanted})
