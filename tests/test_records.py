"""Delimited files with line breaks inside quotes, read split by split, against Spark's multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F

from occura.sources import delimited, records
from occura.sources.manifest import Dialect
from occura.storage import put_text, scratch

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    spark.conf.set(SPLITS[0], "64")
    spark.conf.set(SPLITS[1], "0")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def values(rng, end):
    """A record's text: plain, quoted and odd values."""
    plain = ["", "a", "bc d", "é日", " x ", "it's", "5", 'mid"quote', 'end"', " \"lead", "1,5".replace(",", ".")]
    quoted = ['""', '"a,b"', f'"two{end}lines"', f'"{end}"', f'"x{end}{end}{end}y,z"', '"say ""hi"""', '""""', f'"q"" {end}, ""w"', f'"{"long " * 20}{end}tail"', '"odd"rest', '"odd" rest']
    return ",".join(rng.choice(quoted if rng.random() < 0.4 else plain) for _ in range(3))


def read(df):
    """The rows; a break of two characters counts as one, as the multi-line reader shortens it in some values (with escaped quotes) and keeps it in others."""
    return sorted(repr(r).replace("\\r\\n", "\\n") for r in df.collect())


@pytest.mark.parametrize("seed", range(12))
def test_records_are_those_of_the_multi_line_reader(spark, small_splits, seed):
    rng = random.Random(seed)
    end = "\r\n" if seed % 3 == 2 else "\n"
    lines = ["﻿a,b,c" if seed % 2 else "a,b,c", *(values(rng, end) for _ in range(40))]
    path = f"{scratch(spark, 'csv')}/f.csv"
    put_text(spark, path, end.join(lines) + (end if rng.random() < 0.5 else ""))
    found = delimited.read_files(spark, [path], Dialect())
    assert read(found) == read(delimited.read_files(spark, [path], Dialect(), multi_line=True))


def test_many_tasks_read_one_file(spark, small_splits):
    path = f"{scratch(spark, 'csv')}/f.csv"
    put_text(spark, path, "id;note\n" + "".join(f'{k};"line {k}\nand ""more"";"\n' for k in range(300)))
    found = records.records(spark, path, Dialect(";"))
    assert found.rdd.getNumPartitions() > 50
    df = delimited.read_files(spark, [path], Dialect(";"))
    assert sorted((int(r.id), r.note) for r in df.collect()) == [(k, f'line {k}\nand "more";') for k in range(300)]
    assert df.filter(F.col("note").contains("more")).count() == 300


def test_a_value_over_many_splits_and_the_files_end(spark, small_splits):
    long = "\n".join(f"{k} text" for k in range(400))
    path = f"{scratch(spark, 'csv')}/f.csv"
    put_text(spark, path, f'id,note\n1,"{long}"\n2,"b\nc"\n3,x\n4,"{long}"')
    rows = {r.id: r.note for r in delimited.read_files(spark, [path], Dialect()).collect()}
    assert rows == {"1": long, "2": "b\nc", "3": "x", "4": long}


def test_lone_carriage_returns_are_left_to_the_multi_line_reader(spark):
    path = f"{scratch(spark, 'csv')}/f.csv"
    put_text(spark, path, 'id,note\n1,"a\rb\nc"\n2,d\n')
    assert {r.id: r.note for r in delimited.read_files(spark, [path], Dialect()).collect()} == {"1": "a\rb\nc", "2": "d"}


def test_files_without_a_header_and_with_a_reordered_one(spark, small_splits):
    folder = scratch(spark, "csv")
    put_text(spark, f"{folder}/a.csv", 'id,note\n1,"x\ny"\n')
    put_text(spark, f"{folder}/b.csv", '2,"p\nq"\n3,r\n')
    put_text(spark, f"{folder}/c.csv", 'note,id\n"s\nt",4\n')
    df = delimited.read_files(spark, [f"{folder}/{n}.csv" for n in "abc"], Dialect())
    assert {r.id: r.note for r in df.collect()} == {"1": "x\ny", "2": "p\nq", "3": "r", "4": "s\nt"}
