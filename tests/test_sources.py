"""Sources, standardization, contracts and guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from swipewatch.operators import quality as Q
from swipewatch.sources import contracts as C
from swipewatch.sources import readers as S

HEADER = ",".join(Q.RAW_COLUMNS)
LINES = [
    "7,0,2002,9,1,06:21,$134.09,Swipe Transaction,3527213246127876953,La Verne,CA,91750.0,5300,,No",
    '7,1,2002,9,12,06:21:30,"$-1,234.50",Online Transaction, 99 ,ONLINE,,,5411,Bad CVV, YES ',
    "8,0,2002,13,1,06:21,abc,,1,,,,5411,,maybe",
]


def write(tmp_path, text, name="raw.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_header_contract(spark, tmp_path):
    good = write(tmp_path, HEADER + "\n" + "\n".join(LINES) + "\n")
    assert S.read_raw_csv(spark, good).columns == Q.RAW_COLUMNS
    marked = write(tmp_path, "﻿" + HEADER + "\n" + LINES[0] + "\n", "bom.csv")
    assert S.read_raw_csv(spark, marked).first()["User"] == "7"
    swapped = write(tmp_path, HEADER.replace("User,Card", "Card,User") + "\n" + LINES[0] + "\n", "bad.csv")
    with pytest.raises(ValueError, match="contract"):
        S.read_raw_csv(spark, swapped)


def test_csv_to_parquet_and_standardize(spark, tmp_path):
    S.csv_to_parquet(spark, write(tmp_path, HEADER + "\n" + "\n".join(LINES) + "\n"), str(tmp_path / "out"))
    typed = {r["source_row_id"]: r for r in S.standardize(S.open_table(spark, str(tmp_path / "out"), "raw_test")).collect()}
    assert sorted(typed) == [1, 2, 3]
    first, second, third = typed[1], typed[2], typed[3]
    assert first["transaction_timestamp"] == dt.datetime(2002, 9, 1, 6, 21) and first["amount"] == 134.09 and first["fraud_label"] == 0
    assert second["transaction_timestamp"] == dt.datetime(2002, 9, 12, 6, 21, 30) and second["amount"] == -1234.5 and second["fraud_label"] == 1
    assert second["card_key"] == "7:1" and second["merchant_id_raw"] == "99" and second["merchant_state"] is None and second["errors_raw"] == "Bad CVV"
    assert third["transaction_timestamp"] is None and third["amount"] is None and third["fraud_label"] is None and third["use_chip"] is None


def test_row_ids_are_contiguous_over_partitions_and_shuffles(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey")
    for df, scan in ((files, True), (files.repartition(7), False), (files.distinct(), False)):
        ids = [r[0] for r in S.add_row_id(df, scan=scan).select("source_row_id").collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1))


def test_load_by_suffix(spark, sf_dir, tmp_path):
    assert S.load(spark, f"{sf_dir}/nation.parquet").count() == 25
    assert S.load(spark, write(tmp_path, "a,b\n1,2\n", "x.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError, match="unsupported"):
        S.load(spark, "table.json")


def test_inventory_of_other_date_columns(spark):
    df = spark.createDataFrame([("2020-01-02", 1), ("03/04/2021", 2), ("2022-05-06T07:08:09", 3), ("bad", 4)], ["trans_date", "x"])
    row = S.inventory(df).first()
    assert (row["row_count"], row["column_count"], str(row["date_min"]), str(row["date_max"])) == (4, 2, "2020-01-02", "2022-05-06")


def test_firewalls(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], ["source_row_id", "risk_score", "fraud_label"])
    with pytest.raises(ValueError, match="firewall"):
        C.assert_policy_columns(df.columns)
    with pytest.raises(ValueError, match="outcome"):
        C.operational_view(df)
    with pytest.raises(ValueError, match="column fraud_label"):
        C.matured_view(df.drop("fraud_label"))
    with pytest.raises(ValueError):
        C.matured_view(df, "GUESSED")
    with pytest.raises(ValueError):
        C.assert_label_mode("OPERATIONS_NOW", True)
    with pytest.raises(ValueError):
        C.assert_label_mode("OUTCOMES_MATURED", False)


def test_public_guard_looks_into_nested_columns(spark):
    nested = spark.range(1).select(F.struct(F.array(F.struct(F.lit(1).alias("Risk_Score"))).alias("inner")).alias("outer"))
    with pytest.raises(ValueError, match="risk_score"):
        C.assert_public(nested)
    assert C.assert_public(spark.range(1).toDF("transactions")).columns == ["transactions"]


def test_export_is_one_ordered_csv(spark, tmp_path):
    C.export_report(spark.createDataFrame([("b", 2), ("a", 1)], ["segment", "n"]), str(tmp_path / "report"), ["segment"])
    parts = list((tmp_path / "report").glob("part-*.csv"))
    assert len(parts) == 1 and parts[0].read_text().split() == ["segment,n", "a,1", "b,2"]


def test_lenient_booleans_reject_other_words(spark):
    df = spark.createDataFrame([("Yes",), ("0",), (None,)], ["w"])
    assert [r[0] for r in df.select(C.lenient_boolean("w")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("perhaps",)], ["w"]).select(C.lenient_boolean("w")).collect()


def test_monitoring_contract_fails_closed(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1.0, 0.5, "X"), (1, "bad", None, 1.5, "X")], ["source_row_id", "transaction_timestamp", "amount", "risk_score", "split_name"])
    found = {r["rule"]: r["violations"] for r in C.monitoring_contract(df).collect()}
    assert found == {"source_row_id_unique_non_null": 1, "transaction_timestamp_parseable": 1, "amount_finite": 1, "risk_score_in_unit_interval": 1, "action_domain": 0}
    with pytest.raises(ValueError, match="broken"):
        C.require_monitoring_contract(df)
    with pytest.raises(ValueError, match="missing"):
        C.monitoring_contract(df.drop("amount"))


def test_score_gate(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 0.5, 1.0, "A"), (2, "2020-01-02", 1.5, 1.0, "A")], ["source_row_id", "transaction_timestamp", "risk_score", "amount", "split_name"])
    status = {r["check_name"]: r["status"] for r in C.score_gate(df, "PROBABILITY_USABLE", "C1").collect()}
    assert status["P7T05_score_range"] == "FAIL" and status["P7T09_calibration_metadata"] == "PASS" and len(status) == 9
    assert C.gate_status(C.score_gate(df, "PROBABILITY_USABLE", "C1")).first()["gate_status"] == "INPUT_BLOCKED"
    assert C.gate_status(C.score_gate(df.where("risk_score < 1"), "RANKING_ONLY")).first()["gate_status"] == "SCORE_GATE_LOCKED"
    assert C.score_gate(df.drop("amount"), "RANKING_ONLY").count() == 1


def test_duplicates_and_report_comparison(spark):
    raw = spark.createDataFrame([("a", "1", "Yes"), ("a", "1", "No"), ("b", None, "No"), ("b", None, "No")], ["x", "y", "Is Fraud?"])
    got = {r["metric"]: r["value"] for r in Q.duplicate_audit(raw, ["x", "y"]).collect()}
    assert got == {"exact_duplicate_rows_excluding_source_row_id": 2, "feature_duplicate_groups_excluding_label": 2, "conflicting_label_groups": 1}
    live = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], ["k", "v"])
    stored = spark.createDataFrame([("a", 1.0 + 1e-13), ("b", 2.1), ("c", 3.0)], ["k", "v"])
    status = {r["metric"]: r["status"] for r in Q.compare_reports(live, stored, ["k"], {"v": 1e-12}).collect()}
    assert status == {"a": "PASS", "b": "FAIL", "": "FAIL", "c": "FAIL"}


def test_fingerprint_tells_rows_apart_that_only_separators_join(spark):
    mark = lambda rows, schema="a string, b string": Q.fingerprint(spark.createDataFrame(rows, schema)).first()["hash_sum"]
    pairs = [[("x|y", "z")], [("x", "y|z")], [(None, "z")], [("<NULL>", "z")], [("N", "z")], [("", "z")], [("xb=T1:y", "z")], [("x", "b=T1:y")], [("x", "y"), ("x", "y")]]
    assert len({mark(rows) for rows in pairs}) == len(pairs)


def test_fingerprint_of_every_type(spark):
    import datetime as dt

    odd = [0.0, 1.0, -1.0, 0.1, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 4.0, 3.9999999999999996, 1 / 3, 8.0, 1e22, None]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    texts = [r[0] for r in df.select(Q.canonical(F.col("x"), df.schema["x"].dataType)).collect()]
    assert len(set(texts)) == len(odd)
    for x, text in zip(odd, texts, strict=True):
        if "p" in text:
            m, e = text[1:].split("p")
            assert int(m) * 2.0 ** (int(e) - 52) == x if -1000 < int(e) else True
    assert Q.fingerprint(spark.createDataFrame([(-0.0,)], "x double")).first() == Q.fingerprint(spark.createDataFrame([(0.0,)], "x double")).first()
    row = (1, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), True, b"\x00|", [1, None], {"k": [2.5], "a": None}, ("s", 2))
    schema = "i int, d date, t timestamp_ntz, f boolean, z binary, l array<int>, m map<string,array<double>>, r struct<p:string,q:int>"
    wide = spark.createDataFrame([row], schema)
    assert wide.select(Q.canonical(F.col("t"), wide.schema["t"].dataType)).first()[0] == "S-1" and wide.select(Q.canonical(F.col("d"), wide.schema["d"].dataType)).first()[0] == "A-1"
    marks = {Q.fingerprint(spark.createDataFrame([tuple(None if j == i else v for j, v in enumerate(row))], schema)).first()["hash_sum"] for i in range(-1, len(row))}
    assert len(marks) == len(row) + 1


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 3)
    assert Q.fingerprint(a).first() == Q.fingerprint(a.orderBy(F.desc("id")).repartition(5)).first()
    assert Q.fingerprint(a).first() != Q.fingerprint(a.where("id < 99")).first()


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,2\n")
    (tmp_path / "b.csv").write_text("B,A\n3,4\n")
    with pytest.raises(Exception, match="header|Header"):
        S.read_raw_csv(spark, str(tmp_path), ("A", "B")).collect()
    (tmp_path / "b.csv").write_text("A,B\n3,4\n")
    assert sorted(map(tuple, S.read_raw_csv(spark, str(tmp_path), ("A", "B")).collect())) == [("1", "2"), ("3", "4")]


def test_conform_reads_each_field_once(spark):
    fields = (S.Field("a", renames=("x",)), S.Field("b", copies=("y",)), S.Field("c", default=lambda: F.lit(7)), S.Field("d"))
    out = S.conform(spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), fields)
    assert out.columns == ["y", "z", "a", "b", "c"] and tuple(out.first()) == (2, 3, 1, 2, 7)
    with pytest.raises(ValueError, match="misses"):
        S.conform(out, (S.Field("e", required=True),))
