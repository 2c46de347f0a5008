"""Registered queries on the smallest tables."""

import glob
import os

import duckdb
import pytest

from codestrata.llm import queries as Q
from codestrata.llm.syntax import unit_edits


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in Q.SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        want = con.execute(Q.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want.fetchall())


def test_p5_repairs_units_of_any_damage(spark, tmp_path):
    """The flags come from the whole repair: no number of edits ends it."""
    words = " ".join(["word"] * 60)
    sources = [("bad", "a.java", f"class A {{ {words} }}"), ("good", "b.java", "class A { int x = 1; }"), ("text", "c.py", words)]
    spark.createDataFrame(sources, "file_id string, relative_path string, source string").write.parquet(f"{tmp_path}/source_files.parquet")
    jobs = [("bad", None), ("job", "SyntaxError: invalid syntax"), ("late", "timed out")]
    spark.createDataFrame(jobs, "file_id string, error_message string").selectExpr("*", "timestamp'2024-01-01' as updated_at").write.parquet(f"{tmp_path}/file_parse_jobs.parquet")
    rows = {r["file_id"]: r for r in Q._broken_files(spark, str(tmp_path)).collect()}
    assert {k: r["broken"] for k, r in rows.items()} == {"bad": True, "good": False, "text": True, "job": True, "late": False}
    kinds = {r["file_id"]: r["edits"] for r in Q.p5_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {k: rows[k]["edits"] for k in kinds}
    assert kinds["text"] == 30 and kinds["bad"] == unit_edits("java", "Mem", " ".join(["n"] * 60)) > 20
    assert {r["file_id"] for r in Q.p5_found(spark, str(tmp_path)).collect()} == {"bad", "text", "job"}
