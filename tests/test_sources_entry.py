"""A sources and the driver contract."""

import os
import shutil
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from concord.sources import audit, capture, catalog, checksum, ingest


def test_register_views_errors(spark, sf):
    with pytest.raises(catalog.DatasetError):
        catalog.register_views(spark, {})
    with pytest.raises(catalog.DatasetError):
        catalog.register_views(spark, {"x": "/nonexistent/x.parquet"})
    v = catalog.register_views(spark, {"nation_v": f"{sf}/nation.parquet"})
    assert spark.table("nation_v").count() == v["nation_v"].count() == 25


def test_table_names_and_collisions(spark):
    listing = spark.createDataFrame([("/a/My File-1.csv",), ("/b/my_file_1.parquet",), ("/c/__.csv",)], "path string")
    got = {r.path: (r.table_name, r.collision) for r in ingest.resolve_table_names(listing).collect()}
    assert got["/a/My File-1.csv"] == ("my_file_1", True)
    assert got["/c/__.csv"] == ("table_data", False)
    with pytest.raises(ingest.TableNameCollision):
        ingest.ingest_files(spark, ["/a/x.csv", "/b/X.csv"], tempfile.mkdtemp(prefix="concord-t-"))


def test_ingest_export_capture_roundtrip(spark, sf):
    d = tempfile.mkdtemp(prefix="concord-t-")
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    paths = ingest.export_csv({"nation": nation}, d)
    back = ingest.ingest_csv(spark, paths["nation"], os.path.join(d, "nation_pq"))
    assert back.count() == 25 and set(back.columns) == set(nation.columns)
    cap = capture.capture_result(nation.filter(F.col("n_regionkey") < 2), "exec-1", d)
    assert cap.row_count == nation.filter(F.col("n_regionkey") < 2).count()
    assert cap.sample.count() == cap.row_count and cap.columns[0][0] == "n_nationkey"


def test_checksum_is_order_independent(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    a = checksum.table_checksum(o, "orders").first().checksum
    b = checksum.table_checksum(o.repartition(5).orderBy(F.rand(1)), "orders").first().checksum
    c = checksum.table_checksum(o.limit(10), "orders").first().checksum
    assert a == b and a != c


def test_preview_and_catalog(spark, sf):
    t = {"orders": spark.read.parquet(f"{sf}/orders.parquet"), "nation": spark.read.parquet(f"{sf}/nation.parquet")}
    assert catalog.preview(t, "NATION", 1000).count() == 25
    assert catalog.preview(t, "missing", 0).count() == 1      # clamp to 1, falls back to first table
    m = catalog.table_manifest(t, "ds")
    cs = catalog.catalog_summary(m).collect()[0]
    assert cs.table_count == 2 and cs.total_rows == t["orders"].count() + 25
    assert catalog.catalog_search(catalog.catalog_summary(m), "D").count() == 1


def test_audit_append_and_lookup(spark):
    root = tempfile.mkdtemp(prefix="concord-audit-")
    rows = spark.createDataFrame([("v1", "2026-01-01 00:00:00", "PASS"), ("v2", "2026-01-02 00:00:00", "FAIL")],
                                 "validation_id string, created_at string, status string")
    audit.append_audit(rows, root, "validation", "validation_id")
    got = audit.get_audit(spark, root, "validation").collect()
    assert [r.record_id for r in got] == ["v2", "v1"]
    assert audit.get_audit(spark, root, "validation", "v1").count() == 1


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and {r.check_name for r in rows} >= {"SchemaValidator", "RowValidator"}
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


@pytest.mark.parametrize("without", [("concord/llm", "tests/llm"), ("concord/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_loads_without_the_corpus_operators(tmp_path, without):
    import __spark_entry__ as e
    here = os.path.dirname(os.path.abspath(e.__file__))
    gone = {os.path.join(here, w) for w in without}
    shutil.copytree(here, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(d, n) in gone])
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(e.__file__, len(q), set(o) <= set(q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()
    assert out[0].startswith(str(tmp_path)) and int(out[1]) >= 90 and out[2:] == ["True", "False"]


def test_compare_pair_and_export_parquet(spark, sf):
    from concord.operators.compare.report import compare_pair, run_checks
    s, t = compare_pair(spark, "SELECT n_nationkey, n_name FROM nat WHERE n_regionkey < 3",
                        "SELECT n_nationkey, n_name FROM nat WHERE n_regionkey <= 3",
                        {"nat": f"{sf}/nation.parquet"})
    checks = {r.check_name: r for r in run_checks(s, t).collect()}
    assert checks["RowValidator"].status == "FAIL" and checks["SchemaValidator"].status == "PASS"
    d = tempfile.mkdtemp(prefix="concord-t-")
    out = ingest.export_parquet({"nation": spark.read.parquet(f"{sf}/nation.parquet")}, d)
    assert spark.read.parquet(out["nation"]).count() == 25


def test_repair_confidence(spark):
    from concord.operators.diagnose import repair_confidence
    df = spark.createDataFrame([(0.98, True, True, True), (0.5, True, False, True), (0.9, True, True, False)],
                               "d double, s boolean, c boolean, m boolean")
    got = [r[0] for r in df.select(repair_confidence(F.col("d"), F.col("s"), F.col("c"), F.col("m"))).collect()]
    assert got == [0.95, 0.0, 0.86]
