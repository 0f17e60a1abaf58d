"""The doubles next to the missing values against their SQL, row by row: they are too large to be added up."""

from pyspark.sql import functions as F

from marlstone.plans.queries import ORACLES, QUERIES


def test_null_part_keys_equal_sql(spark, tmp_path):
    import duckdb

    rows = spark.range(0, 900, 1, 3).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), F.when(F.col("id") % 5 > 0, F.col("id") * 37).alias("l_partkey"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = QUERIES["missing_double"](spark, str(tmp_path))
    want = con.execute(ORACLES["missing_double"]).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert sum(r[2] is None and r[3] is None for r in want) == 180 and sum(r[2] is not None for r in want) == 90
