import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.sources.staged import StagedTable, bad_rows, good_rows, ingest_csv

SCHEMA = "id bigint, name string, amount double, day date"


def ingest(spark, folder, text, **options):
    source = folder / "in.csv"
    source.write_text(text)
    table = StagedTable(spark, str(folder / "table"))
    return table, ingest_csv(spark, str(source), SCHEMA, table, **options)


def test_every_line_is_good_or_bad(spark, tmp_path):
    table, made = ingest(
        spark,
        tmp_path,
        "Id,Name , Amount,Day\n"
        '1,"a, ""quoted""",2.5,2020-01-01\n'
        '2,"b, b",x,2020-01-02\n'
        "3,c,1\n"
        "4,d,1,2020-01-03,extra\n"
        "5,e,,2020-13-01\n"
        ",f,1.00,2020-01-04\n"
        '7,"",,\n',
        required=["id"],
    )
    assert made["counts"] == {"rows": 7, "bad": 5}
    good = [tuple(r) for r in good_rows(table).orderBy("id").collect()]
    assert [(g[0], g[1], g[2], str(g[3])) for g in good] == [
        (1, 'a, "quoted"', 2.5, "2020-01-01"),
        (7, None, None, "None"),
    ]
    assert {(r.raw, r.reason) for r in bad_rows(table).collect()} == {
        ('2,"b, b",x,2020-01-02', "amount is no double"),
        ("3,c,1", "wrong number of fields"),
        ("4,d,1,2020-01-03,extra", "wrong number of fields"),
        ("5,e,,2020-13-01", "day is no date"),
        (",f,1.00,2020-01-04", "id is missing"),
    }


def test_a_line_is_bad_whatever_columns_are_read(spark, tmp_path):
    table, _ = ingest(spark, tmp_path, "id,name,amount,day\n1,a,x,2020-01-01\n2,b,1,2020-01-01\n")
    assert [r.id for r in good_rows(table).select("id").collect()] == [2]
    plan = good_rows(table).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bad" in plan and "raw" not in plan.split("ReadSchema")[1]


def test_missing_value_text_and_lines_in_quotes(spark, tmp_path):
    table, made = ingest(
        spark, tmp_path, 'id,name,amount,day\n1,"two\nlines",NA,NA\n', multiline=True, null_text="NA"
    )
    assert made["counts"] == {"rows": 1, "bad": 0}
    assert [tuple(r) for r in good_rows(table).collect()] == [(1, "two\nlines", None, None)]


def test_no_lines_at_all(spark, tmp_path):
    table, made = ingest(spark, tmp_path, "id,name,amount,day\n")
    assert made["counts"] == {"rows": 0, "bad": 0}
    assert good_rows(table).count() == bad_rows(table).count() == 0
    with pytest.raises(ValueError, match="reason"):
        ingest_csv(spark, str(tmp_path / "in.csv"), "reason string", table)


def test_unfinished_commits_are_never_read(spark, tmp_path):
    table = StagedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = spark.range(10).withColumn("text", F.lit('a "b", c'))
    assert table.commit(rows, "csv")["counts"] == {"rows": 10}
    broken = rows.withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        table.commit(broken)
    (tmp_path / "t" / "data" / "left").mkdir()
    assert table.versions() == [1]
    assert {tuple(r) for r in table.read().collect()} == {(i, 'a "b", c') for i in range(10)}
    table.commit(rows.limit(3), "parquet", partition_by=["id"])
    assert table.versions() == [1, 2]
    assert table.read().count() == 3 and table.read(1).count() == 10
    assert table.vacuum() == 2 and len(os.listdir(tmp_path / "t" / "data")) == 2
    assert table.read().count() == 3 and table.read(1).count() == 10


def test_a_taken_version_raises(spark, tmp_path):
    table = StagedTable(spark, str(tmp_path / "t"))
    table.commit(spark.range(1))
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(1, json.dumps({}))
    assert table.read().count() == 1


def test_scratch_goes_with_the_session(tmp_path):
    code = (
        "from panelforge.session import local_session, scratch_path\n"
        f"s = local_session(1, 'scratch', spark__checkpoint__dir={str(tmp_path)!r})\n"
        "p = scratch_path(s, 'x')\n"
        "s.range(3).write.parquet(p)\n"
        "print(s.read.parquet(p).count(), p)\n"
    )
    root = Path(__file__).parent.parent
    done = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True, timeout=120
    )
    count, path = done.stdout.split()
    assert count == "3" and path.startswith(str(tmp_path))
    assert not Path(path).parent.exists()
