"""Readers, sinks and their failure messages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelsight.sources import quoted_csv, readers, sinks
from parcelsight.sources.schemas import RAW_SCHEMAS


def test_csv_with_line_breaks_quotes_and_leading_zeros(spark, tmp_path):
    (tmp_path / "reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"two\nlines, and a ""quote""",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
        "r2,o2,1,,,2018-03-10 00:00:00,\n")
    (tmp_path / "customers.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        "c1,u1,01037,sao paulo,SP\n")
    reviews = readers.read_raw(spark, str(tmp_path), "reviews").orderBy("review_id").collect()
    assert reviews[0]["review_comment_message"] == 'two\nlines, and a "quote"'
    assert reviews[0]["review_answer_timestamp"] == dt.datetime(2018, 1, 18, 21, 46, 59)
    assert reviews[1]["review_answer_timestamp"] is None
    customers = readers.read_raw(spark, str(tmp_path), "customers")
    assert customers.first()["customer_zip_code_prefix"] == "01037"
    assert customers.schema == RAW_SCHEMAS["customers"]


@pytest.fixture()
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that records lie across them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("break_", ["\n", "\r\n"])
def test_quoted_csv_in_ranges_equals_the_reader_of_whole_files(spark, tmp_path, small_ranges, break_):
    rng = random.Random(3)
    pieces = ["plain", "é ü 가", 'a ""quote""', "one\ntwo", "\n\n", ",", "x" * 700, "", "l\n" * 90, '""', "two\r\nlines"]
    for k in range(2):
        rows = ["id,note,more"]
        for i in range(150):
            note = "".join(rng.choices(pieces, k=rng.randint(0, 3)))
            rows.append(f'{k}-{i},"{note}",' + rng.choice(["", "z", '""', '"q,r"']))
            if i % 40 == 7:
                rows.append("")
        (tmp_path / f"part{k}.csv").write_text(break_.join(rows) + break_ * k, encoding="utf-8", newline="")
    want = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path))
    assert got.columns == want.columns
    canonical = lambda df: sorted(map(str, df.collect()))
    assert canonical(got) == canonical(want) and got.count() == 300
    records = quoted_csv.quoted_records(spark, str(tmp_path))
    tasks = records.groupBy(F.spark_partition_id()).count().count()
    assert records.rdd.getNumPartitions() > 20 and tasks > 20
    parities = quoted_csv.range_parities(quoted_csv._lines(spark, str(tmp_path)))
    assert parities.where("inside").count() > 5 and parities.where("NOT closed").count() == 0


def test_quoted_csv_of_broken_and_empty_files(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "none.csv").write_text("a,b\n")
    none = quoted_csv.read_quoted_csv(spark, str(tmp_path / "none.csv"))
    assert none.columns == ["a", "b"] and none.collect() == []


def test_csv_columns_by_name_and_malformed_values(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text(
        "seller_state,extra,seller_id,seller_city,seller_zip_code_prefix\nSP,x,s1,campinas,01001\n")
    row = readers.read_raw(spark, str(tmp_path), "sellers").first()
    assert (row["seller_id"], row["seller_state"], row["seller_zip_code_prefix"]) == ("s1", "SP", "01001")
    names = RAW_SCHEMAS["payments"].fieldNames()
    values = {n: "1" for n in names} | {"payment_installments": "abc", "order_id": "o", "payment_type": "card"}
    (tmp_path / "payments.csv").write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    assert readers.read_raw(spark, str(tmp_path), "payments", malformed="null").first()["payment_installments"] is None
    counts = {r["column"]: r["malformed"] for r in readers.malformed_counts(spark, str(tmp_path), "payments").collect()}
    assert counts["payment_installments"] == 1 and sum(counts.values()) == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_raw(spark, str(tmp_path), "payments").collect()
    copied = readers.convert_to_parquet(spark, str(tmp_path), str(tmp_path / "p"), "sellers")
    assert copied.first()["seller_id"] == "s1" and copied.schema == RAW_SCHEMAS["sellers"]


def test_parquet_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "order_items.parquet")
    spark.createDataFrame([("o", 1, "p", "s", None, float("nan"), 2.0)],
                          RAW_SCHEMAS["order_items"]).write.parquet(path)
    row = readers.read_raw(spark, str(tmp_path), "order_items", "parquet").first()
    assert (row["price"], row["freight_value"]) == (None, 2.0)


def test_unknown_format_and_missing_snapshot(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_raw(spark, str(tmp_path), "orders", "xml")
    with pytest.raises(FileNotFoundError, match="prepare"):
        readers.read_snapshot(spark, str(tmp_path / "none"), "prepare")


def test_snapshot_and_result_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "가"), (2, None)], "k int, v string")
    sinks.write_snapshot(df, str(tmp_path / "snap"), partition_by=["k"])
    back = readers.read_snapshot(spark, str(tmp_path / "snap"), "prepare")
    assert sorted((r["k"], r["v"]) for r in back.collect()) == [(1, "가"), (2, None)]
    sinks.write_result(df, str(tmp_path / "result"))
    files = list((tmp_path / "result").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "k,v"


def test_staged_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = sinks.staging_root(spark)
    if named:
        assert root == named.rstrip("/")
    staged = sinks.stage(spark.range(5).toDF("k"), "label")
    assert staged.count() == 5
    if named:
        assert all(root in f for f in staged.inputFiles())
