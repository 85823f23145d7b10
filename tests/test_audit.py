"""Audit tables: what is written by jobs and by micro-batches is read again, and tables are made once."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quantspark.schemas import AUDIT, AUDIT_VERSION
from quantspark.sources import audit
from quantspark.sources.audit import append_audit, compact_audit, create_audit_tables, current_audit_orders, drop_compacted_batches, insert_audit, latest_audit_status, read_audit
from quantspark.sources.shared import shared_dir


def rows_of(spark, ids):
    return spark.createDataFrame([(f"run{i % 3}" if i % 4 else None, i, "sim", "bad") for i in ids], "run_id string, seq long, where_text string, message string").selectExpr("*", "CAST(seq AS DOUBLE) AS ts_epoch_s")


def test_appended_rows_and_batches_are_read_together(spark, tmp_path):
    path = str(tmp_path)
    assert read_audit(spark, "errors", path).count() == 0
    append_audit(rows_of(spark, range(10)), "errors", path)
    append_audit(rows_of(spark, range(10, 15)), "errors", path, 0)
    append_audit(rows_of(spark, range(15, 20)), "errors", path, 1)
    append_audit(rows_of(spark, range(10, 15)), "errors", path, 0)  # a batch that is run again
    append_audit(rows_of(spark, range(20, 22)), "errors", path)
    got = read_audit(spark, "errors", path)
    assert got.columns == [c.split()[0] for c in AUDIT["errors"].split(", ")]
    assert sorted(r.seq for r in got.collect()) == list(range(22))
    assert {r.seq: r.run_id for r in got.collect()} == {i: f"run{i % 3}" if i % 4 else None for i in range(22)}


def test_batches_alone_are_read(spark, tmp_path):
    append_audit(rows_of(spark, range(5)), "errors", str(tmp_path), 3)
    assert read_audit(spark, "errors", str(tmp_path)).count() == 5


def test_tables_are_made_once_with_their_version(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS audit_test")
    create_audit_tables(spark, "audit_test")
    for name, ddl in AUDIT.items():
        table = f"audit_test.audit_{name}"
        assert sorted(spark.table(table).columns) == sorted(c.split()[0] for c in ddl.split(", "))
        assert {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}["audit.version"] == str(AUDIT_VERSION)
    rows_of(spark, range(4)).select(*spark.table("audit_test.audit_errors").columns).write.insertInto("audit_test.audit_errors")
    create_audit_tables(spark, "audit_test")
    assert spark.table("audit_test.audit_errors").count() == 4
    spark.sql("DROP DATABASE audit_test CASCADE")


def seqs(spark, path):
    return sorted(r.seq for r in read_audit(spark, "errors", path).collect())


def test_compaction_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    """Before, between and after the two steps, with retries, batches that come later and batches that come again."""
    path = str(tmp_path)
    assert compact_audit(spark, "errors", path) == -1
    append_audit(rows_of(spark, range(5)), "errors", path)
    for k in range(3):
        append_audit(rows_of(spark, range(5 + 5 * k, 10 + 5 * k)), "errors", path, k)
    with monkeypatch.context() as m:
        m.setattr(audit, "_publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError, match="died"):
            compact_audit(spark, "errors", path)
    assert seqs(spark, path) == list(range(20))  # the folder is written, and nothing names it
    before = read_audit(spark, "errors", path)
    assert compact_audit(spark, "errors", path) == 2 and seqs(spark, path) == list(range(20))
    assert sorted(r.seq for r in before.collect()) == list(range(20))  # a reader that had begun
    append_audit(rows_of(spark, range(5, 10)), "errors", path, 0)  # comes again
    append_audit(rows_of(spark, range(20, 22)), "errors", path, 3)
    assert seqs(spark, path) == list(range(22))
    drop_compacted_batches(spark, "errors", path)
    assert [p.name for p in (tmp_path / "errors_batches").glob("batch=*")] == ["batch=3"] and seqs(spark, path) == list(range(22))
    assert compact_audit(spark, "errors", path) == 3 and compact_audit(spark, "errors", path) == 3
    drop_compacted_batches(spark, "errors", path)
    assert seqs(spark, path) == list(range(22))
    run1 = read_audit(spark, "errors", path).filter("run_id = 'run1'")
    assert sorted(r.seq for r in run1.collect()) == [k for k in range(22) if k % 3 == 1 and k % 4]
    assert "PartitionFilters: [isnotnull(run_id" in run1._jdf.queryExecution().toString()


def test_orders_are_looked_up_without_a_shuffle(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucket_test")
    create_audit_tables(spark, "bucket_test", 4)
    cols = lambda name: {f: F.lit(None) for f in spark.table(f"bucket_test.audit_{name}").columns}
    orders = spark.range(40).select(*[c.alias(n) for n, c in (cols("orders") | {"order_id": F.concat(F.lit("o"), "id"), "seq": F.col("id"), "run_id": F.expr("concat('r', id % 3)"), "status": F.lit("Submitted")}).items()])
    events = spark.range(60).select(*[c.alias(n) for n, c in (cols("order_status_events") | {"order_id": F.expr("concat('o', id % 20)"), "seq": F.col("id"), "run_id": F.expr("concat('r', id % 2)"), "ts_epoch_s": F.col("id").cast("double"), "status": F.expr("concat('s', id)")}).items()])
    insert_audit(orders, "orders", "bucket_test", 4)
    insert_audit(events.filter("seq < 30"), "order_status_events", "bucket_test", 4)
    insert_audit(events.filter("seq >= 30"), "order_status_events", "bucket_test", 4)
    for df in (latest_audit_status(spark, "bucket_test"), current_audit_orders(spark, "bucket_test")):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.order_id: r.status for r in current_audit_orders(spark, "bucket_test").collect()} == {f"o{k}": f"s{k + 40}" if k < 20 else "Submitted" for k in range(40)}
    spark.sql("DROP DATABASE bucket_test CASCADE")


def test_shared_folder_of_a_cluster():
    """A warehouse in a folder of the driver's machine is no place for tables that executors read, unless it is named as such."""
    session = lambda master, named, warehouse: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named}), conf={"spark.sql.warehouse.dir": warehouse})
    assert shared_dir(session("yarn", "hdfs://x/y/", "file:/w")) == "hdfs://x/y"
    assert shared_dir(session("local[8]", None, "file:/w")) == "file:/w/_shared" and shared_dir(session("yarn", None, "hdfs://x/w")) == "hdfs://x/w/_shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn", None, "file:/w"))
