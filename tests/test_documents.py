"""Policy and weight documents: every rule, both notations, no failed job on bad text."""

import json

import pytest

from swipewatch.operators import policy as P
from swipewatch.sources import documents as D

GOOD = {"policy_version": "P7", "review_threshold": 0.5, "block_threshold": 0.9, "review_capacity": 0.1, "priority_method": "AMOUNT_GRAPH"}
WEIGHTS = {"automatic_block_override": {"enabled": False}, "review_priority": {"pair_new": {"enabled": True, "weight": 1.1}, "cold_card": {"enabled": False, "weight": 2}}}


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document int, text string")


def broken(checked):
    return [set(r.broken) for r in checked.orderBy("document").collect()]


def test_each_policy_rule(spark):
    cases = {
        json.dumps(GOOD): set(), json.dumps({**GOOD, "priority_method": None}): set(), json.dumps({k: v for k, v in GOOD.items() if k != "priority_method"}): set(), "{": {D.ONE_OBJECT}, "[1]": {D.ONE_OBJECT}, "": {D.ONE_OBJECT}, "3": {D.ONE_OBJECT},
        json.dumps({**GOOD, "policy_version": ""}): {D.HAS_VERSION}, json.dumps({**GOOD, "block_threshold": "high"}): {D.NUMBERS}, json.dumps({**GOOD, "block_threshold": None}): {D.NUMBERS}, json.dumps({**GOOD, "block_threshold": [1]}): {D.NUMBERS},
        json.dumps({**GOOD, "review_threshold": 0.9}): {D.ORDERED}, json.dumps({**GOOD, "block_threshold": 1.1}): {D.ORDERED}, json.dumps({**GOOD, "review_threshold": -0.1}): {D.ORDERED}, json.dumps({**GOOD, "review_capacity": 1.5}): {D.SHARE}, json.dumps({**GOOD, "review_capacity": "all"}): {D.SHARE},
        json.dumps({**GOOD, "priority_method": "LUCK"}): {D.METHOD}, "{}": {D.HAS_VERSION, D.NUMBERS, D.SHARE}}
    checked = D.policy_documents(docs(spark, [*cases, None]))
    assert broken(checked) == [*cases.values(), {D.ONE_OBJECT}]
    configs = D.policy_configs(checked)
    assert configs[0] == P.PolicyConfig("P7", 0.5, 0.9, 0.1, "AMOUNT_GRAPH") and configs[1].priority_method == "SCORE_ONLY" and set(configs) == {0, 1, 2}
    assert all(not P.broken_rules(c, P.QueueConfig(), P.GRAPH_WEIGHTS) for c in configs.values())
    assert D.policy_documents(docs(spark, [])).count() == 0


def test_each_weight_rule(spark):
    with_ = lambda **flags: json.dumps({**WEIGHTS, "review_priority": flags})
    cases = {
        json.dumps(WEIGHTS): set(), json.dumps({"review_priority": WEIGHTS["review_priority"]}): set(), json.dumps({**WEIGHTS, "automatic_block_override": {"enabled": True}}): {D.NO_OVERRIDE}, with_(): {D.SOME_WEIGHTS}, "{}": {D.SOME_WEIGHTS}, json.dumps({"review_priority": 3}): {D.SOME_WEIGHTS},
        with_(moon={"enabled": True, "weight": 1}): {D.KNOWN_FIELDS}, with_(pair_new={"weight": 1}): {D.DECLARED}, with_(pair_new={"enabled": True}): {D.DECLARED}, with_(pair_new=5): {D.DECLARED}, with_(pair_new={"enabled": True, "weight": 0}): {D.POSITIVE}, with_(pair_new={"enabled": False, "weight": -1}): {D.POSITIVE}, "]": {D.ONE_OBJECT}}
    checked = D.weight_documents(docs(spark, cases))
    assert broken(checked) == list(cases.values())
    assert checked.where("document = 0").first().weights == {"pair_new": 1.1}


def test_yaml_of_configuration_files(spark):
    text = """---
# weights
version: "G: 1"   # quoted
automatic_block_override:
    enabled: false
review_priority:
  pair_new: # the pair
    enabled: true
    weight: 1.10
  cold_card:
    enabled: no thanks
steps:
- ALLOW
- 'it''s'
numbers:
  - 1
  - -2.5e3
empty:
nothing: {}
"""
    got = D.plain_yaml(text)
    assert D.plain_yaml(text.replace("'it''s'", "it's # not")) == got
    assert got == {"version": "G: 1", "automatic_block_override": {"enabled": False}, "review_priority": {"pair_new": {"enabled": True, "weight": 1.1}, "cold_card": {"enabled": "no thanks"}}, "steps": ["ALLOW", "it's"], "numbers": [1, -2500.0], "empty": None, "nothing": {}}
    for bad in ("a: b: c", "a: 1\n a: 2", "a: 1\na: 2", "- a: 1", "a: &x 1", "a: [1, 2]", "a: |\n  text", "\ta: 1", "just words", "a: 1\n  b: 2", "a: \"x\\ny\"", "a: 'x"):
        with pytest.raises(ValueError):
            D.plain_yaml(bad)
    rows = D.yaml_to_json(docs(spark, ["policy_version: P1\nreview_threshold: 0.2\nblock_threshold: 0.4\nreview_capacity: 0", "a: b: c", None, ""]))
    assert broken(D.policy_documents(rows)) == [set(), {D.ONE_OBJECT}, {D.ONE_OBJECT}, {D.ONE_OBJECT}]
