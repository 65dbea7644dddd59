"""Canonical text, keyed compare, plans, snapshots."""

import datetime as dt
import hashlib
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.reconcile import canonical as can
from tillweave.reconcile import compare as cmp
from tillweave.reconcile import schema as sch
from tillweave.reconcile import verdict as ver
from tillweave.sources import snapshot as snap


def text(spark, value, kind, rule=None):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return can.canonicalize(df, {"x": rule} if rule else None).first()[0]


def test_numbers(spark):
    assert text(spark, D("12345678901234567890123456789012345678"), "decimal(38,0)") == "12345678901234567890123456789012345678"
    assert text(spark, D("1.2300"), "decimal(10,4)") == "1.23" and text(spark, D("100.00"), "decimal(10,2)") == "100"
    assert text(spark, D("0.0000000000"), "decimal(38,10)") == "0" and text(spark, D("0.00000001"), "decimal(38,10)") == "0.00000001"
    assert text(spark, D("-0.00"), "decimal(10,2)") == "0" and text(spark, 1.5, "double") == "1.5" and text(spark, 1e-7, "double") == "0.0000001"


def test_text_null_and_padding(spark):
    assert text(spark, "GB ", "string", "char") == "GB " and text(spark, "", "string") == "" and text(spark, None, "string") == can.NULL_TOKEN


def test_times_and_intervals(spark):
    assert text(spark, dt.datetime(2024, 1, 2, 3, 4, 5), "timestamp_ntz") == "2024-01-02T03:04:05"
    assert text(spark, dt.datetime(2024, 1, 2, 3, 4, 5, 60), "timestamp_ntz") == "2024-01-02T03:04:05.000060"
    df = spark.sql("select timestamp'2024-01-01 12:00:00+05:00' a, interval '1-2' year to month b, interval '15' day c, interval '1' month d, interval '30' day e, interval '1 02:00:00.5' day to second f")
    assert tuple(can.canonicalize(df).first()) == ("2024-01-01T07:00:00", "14|0|0", "0|15|0", "1|0|0", "0|30|0", "0|1|7200.5")


def test_collections_objects_and_xml(spark):
    df = spark.sql("select array('b','a','a',null) v, array('b','a','a',null) n, struct(1 as A, 'x' as B) o, '<a  y=\"2\" x=\"1\"/>' d")
    row = can.canonicalize(df, {"n": "collection_nested", "d": "xml"}, {"o": "T_O"}).first()
    null = can.NULL_TOKEN
    assert row["v"] == f"VARR[b\x1fa\x1fa\x1f{null}]" and row["n"] == f"MSET{{{null}\x1fa\x1fa\x1fb}}"
    assert row["o"] == "OBJ<T_O>(a=1\x1fb=x)" and row["d"] == '<a x="1" y="2"></a>'
    assert text(spark, "<a", "string", "xml") == "XML_UNPARSEABLE:" + hashlib.sha256(b"<a").hexdigest()


def test_big_cells(spark):
    got = text(spark, "é" * 20000, "string")
    assert got == f"BIG:len=40000:sha256={hashlib.sha256(('é' * 20000).encode()).hexdigest()}"


def test_classify():
    kinds = ["NUMBER", "CHAR", "VARCHAR2", "DATE", "TIMESTAMP(6)", "TIMESTAMP(6) WITH LOCAL TIME ZONE", "BLOB", "LONG", "INTERVAL YEAR(2) TO MONTH", "INTERVAL DAY TO SECOND", "XMLTYPE", "T_V", "T_N", "T_O"]
    got = can.classify([{"name": str(i), "type": k} for i, k in enumerate(kinds)], {"T_V": "varray", "T_N": "table", "T_O": "object"})
    assert list(got.values()) == ["numeric", "char", "varchar", "date", "timestamp", "timestamp_ltz", "binary", "lob_text", "interval_ym", "interval_ds", "xml", "collection_varray", "collection_nested", "object"]


SRC = [("1", "1.20", "naïve, ok"), ("2", "3.00", "__NULL__"), ("3", "4", "")]


def frames(spark, tgt, cols="order_id string, amount string, comment string"):
    return spark.createDataFrame(SRC, cols), spark.createDataFrame(tgt, cols)


def test_compare_ignores_order_and_counts_everything(spark):
    s, t = frames(spark, list(reversed(SRC)))
    assert cmp.compare_or_raise(s, t.select("comment", "order_id", "amount"), ["order_id"])["status"] == "passed"
    s, t = frames(spark, [SRC[0], ("2", "3.00", ""), ("9", "1", "x")])
    got = cmp.compare_or_raise(s, t, ["order_id"])
    assert (got["missing_keys"], got["extra_keys"], got["changed_rows"], got["changed_key_samples"]) == (1, 1, 1, [["2"]])
    assert {r["column_name"]: r["mismatches"] for r in cmp.cell_diff(s, t, ["order_id"]).collect()} == {"amount": 0, "comment": 1}


@pytest.mark.parametrize("tgt", [[SRC[0], SRC[0]], [("", "1", "x")]])
def test_compare_refuses_bad_keys(spark, tgt):
    s, t = frames(spark, tgt)
    with pytest.raises(ValueError):
        cmp.compare_or_raise(s, t, ["order_id"])


def test_compare_refuses_empty_sides_and_other_columns(spark):
    s, _ = frames(spark, SRC)
    with pytest.raises(ValueError):
        cmp.compare_or_raise(s.limit(0), s.limit(0), ["order_id"])
    with pytest.raises(ValueError):
        cmp.compare(s, s.drop("amount"), ["order_id"])
    with pytest.raises(ValueError):
        cmp.compare(s, s, ["order_id", "order_id"])


def test_names_and_keys():
    assert sch.match_names(["A", "Mixed"], ["a", "Mixed"]) == {"a": "A", "Mixed": "Mixed"}
    for bad in ((["A", "a"], ["a"]), (["B"], ["a"])):
        with pytest.raises(ValueError):
            sch.match_names(*bad)
    cols = [{"name": "id", "nullable": "N", "generated": True}, {"name": "ref", "nullable": "N"}]
    assert sch.choose_key(cols, [{"kind": "primary", "columns": ["id"]}, {"kind": "unique", "columns": ["ref"]}]) == ["ref"]
    assert sch.choose_key(cols, [{"kind": "primary", "columns": ["id"]}]) is None


def test_flags_and_json(spark):
    df = spark.createDataFrame([(D("0"), "null"), (D("0.5"), None), (D("-1"), '{"a": 1.10}'), (None, "{")], "x decimal(4,2), j string")
    assert [tuple(r) for r in df.select(can.bool_flag("x"), can.json_text("j")).collect()] == [(False, "null"), (True, None), (True, '{"a":1.1}'), (None, "NULL_JSON_ERROR")]


def test_rollup(spark):
    rows = [("a", "parity_pass"), ("b", "empty_verified")]
    roll = lambda r, **k: ver.rollup(spark.createDataFrame(r, "table string, result string"), 2, 2, **k).first()
    assert roll(rows)["overall"] == "PASS" and roll(rows + [("c", "parity_fail")])["overall"] == "FAIL" and roll(rows + [("c", None)])["overall"] == "FAIL"
    assert roll(rows, source_only=True)["overall"] == "INCOMPLETE" and roll([])["overall"] == "INCOMPLETE"


COLS = [{"name": "n", "rule": "numeric", "precision": 10, "scale": 3}, {"name": "s", "rule": "varchar"}, {"name": "b", "rule": "binary"}, {"name": "d", "rule": "date"},
        {"name": "i", "rule": "interval_ds"}, {"name": "y", "rule": "interval_ym"}, {"name": "o", "rule": "object", "attributes": [{"name": "A", "rule": "numeric", "precision": 5, "scale": 1}, {"name": "B", "rule": "varchar"}]},
        {"name": "c", "rule": "collection_varray", "element": {"rule": "varchar"}}]


def test_snapshot_tags(spark):
    line = json.dumps([{"$decimal": "1.230"}, "hi", {"$bytes": "eHk="}, {"$datetime": "2024-01-02T03:04:05"}, {"$interval_ds": {"days": 2, "seconds": 3, "microseconds": 4}},
                       {"$interval_ym": {"years": 1, "months": 2}}, {"$oracle_object": "T_O", "attributes": {"A": {"$decimal": "9.5"}, "B": None}}, {"$oracle_collection": "T_C", "values": ["p", "q"]}])
    bad = json.dumps([{"$what": 1}] + [None] * 7)
    df = spark.createDataFrame([(line,), (json.dumps([None] * 8),), (bad,), ("[1]",), ("",)], "value string")
    rows, errors = snap.read_snapshot_lines(df, COLS)
    got = [r for r in rows.drop("y").collect() if r["n"] is not None][0]
    assert got["n"] == D("1.230") and bytes(got["b"]) == b"xy" and got["d"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["i"] == dt.timedelta(days=2, seconds=3, microseconds=4) and tuple(got["o"]) == (D("9.5"), None) and got["c"] == ["p", "q"]
    assert can.canonicalize(rows.select("y")).filter("y = '14|0|0'").count() == 1
    assert sorted(r["reject_reason"] for r in errors.collect()) == ["Unknown source tag in n", "wrong number of cells"]


def test_csv_export(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('order_id,comment\n1,"a, ""b""\nsecond"\n2,\n', encoding="utf-8")
    assert sorted(map(tuple, snap.read_export(spark, str(f), ["order_id"]).collect())) == [("1", 'a, "b"\nsecond'), ("2", "")]
    (tmp_path / "y.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        snap.read_export(spark, str(tmp_path / "y.csv"), ["a"])


def test_tiny_and_huge_doubles_keep_their_digits(spark):
    values = {1.5e-19: "0.00000000000000000015", 0.0: "0", -2.5e-7: "-0.00000025", 1e30: "1" + "0" * 30, 1234567.25: "1234567.25", 1.25e9: "1250000000", float("nan"): "NaN"}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    got = [r[0] for r in df.orderBy("k").select(can._number(F.col("x"), T.DoubleType())).collect()]
    assert got == list(values.values())


def test_values_that_do_not_decode_are_rejected(spark):
    lines = ['[1,{"$decimal":"1.50"}]', '[2,{"$decimal":"abc"}]', '[3,{"$decimal":"1.123456789012345"}]', "[4,null]", '[5,{"$decimal":"1.12300000000000000"}]', '[6,{"$decimal":"5e-11"}]']
    rows, bad = snap.read_snapshot_lines(spark.createDataFrame([(x,) for x in lines], "value string"), [{"name": "id", "rule": "numeric", "scale": 0}, {"name": "x", "rule": "numeric"}])
    assert sorted(int(r["id"]) for r in rows.collect()) == [1, 4, 5]
    assert sorted(r["reject_reason"].split(" in ")[0] for r in bad.collect()) == ["More digits than the column holds", "More digits than the column holds", "Value does not decode"]


@pytest.mark.parametrize("line", ["1", "1,2,3"])
def test_ragged_exports_fail(spark, tmp_path, line):
    (tmp_path / "x.csv").write_text(f"k,v\na,b\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        snap.read_export(spark, str(tmp_path / "x.csv"), ["k"]).select("k").collect()
