import pytest
from pyspark.sql import functions as F

from millrace.operators import ddl


def test_table_life(spark):
    ddl.drop_table(spark, "t_life", "t_other")
    ddl.create_table(spark, "t_life", "id INT, v STRING", primary_key=["id"])
    ddl.create_table(spark, "t_life", "id INT", if_not_exists=True)
    spark.sql("INSERT INTO t_life VALUES (1, 'a'), (2, 'b'), (2, 'c')")
    ddl.add_column(spark, "t_life", "w", "DOUBLE")
    ddl.rename_column(spark, "t_life", "v", "name")
    ddl.update_table(spark, "t_life", {"w": F.lit(1.5)}, F.col("name") == "a")
    ddl.delete_from(spark, "t_life", F.col("name") == "c")
    assert sorted(map(tuple, spark.table("t_life").collect())) == [(1, "a", 1.5), (2, "b", None)]
    ddl.drop_column(spark, "t_life", "w")
    ddl.rename_table(spark, "t_life", "t_other")
    ddl.analyze(spark, "t_other")
    assert spark.table("t_other").columns == ["id", "name"]
    assert ddl.explain_analyze(spark.table("t_other").filter("id > 1"))["rows"] == 1
    ddl.drop_table(spark, "t_other")
    with pytest.raises(ValueError):
        ddl.drop_table(spark, "x; DROP TABLE y")


def test_violations(spark):
    t = spark.createDataFrame([(1,), (1,), (None,), (3,)], "id int")
    assert {(r.id, r.n) for r in ddl.violations(t, ["id"]).collect()} == {(1, 2), (None, 1)}


@pytest.mark.parametrize("bad", ["SELECT 1; SELECT 2", "DROP TABLE t", "DELETE FROM t", "SELECT 1 -- x", "SELECT /* x */ 1", "", "S" * 100_001])
def test_guard(bad):
    with pytest.raises(ValueError):
        ddl.check_sql(bad)


def test_guard_lets_queries_pass():
    assert ddl.check_sql("SELECT ';--' AS a FROM t") and ddl.check_sql("INSERT INTO t VALUES (1)", read_only=False)
