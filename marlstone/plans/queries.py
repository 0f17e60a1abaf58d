"""Queries over `.dta` encodings of the driver's tables, and the SQL over the tables themselves that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions.missing import double_bits_tag, float_bits_tag, is_missing, is_missing_cell, label_key, missing_cell, missing_tag
from ..operators.dataset import Dataset, open_dta, resolve_long_strings
from ..sources.buffers import binary_frame
from .encode import encode_frame

CUSTOMER = {"c_custkey": "long", "c_name": "str25", "c_nationkey": "byte", "c_acctbal": "double", "c_mktsegment": "str12"}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(df: DataFrame, storages: dict, *, options: dict | None = None, **how) -> Dataset:
    return open_dta(df.sparkSession, encode_frame(df, storages, **how), **(options or {}))


SCAN = "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey::TINYINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _scan(name: str, version: int, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset(table(spark, sf_dir, "customer"), CUSTOMER, version=version, order=order).frame()

    QUERIES[name], ORACLES[name] = run, SCAN


for _version in (113, 114, 115, 117, 118, 119):
    _scan(f"scan_customer_v{_version}", _version, "<")
    _scan(f"scan_customer_v{_version}_be", _version, ">")


@query(SCAN)
def scan_customer_binary_files(spark, sf_dir):
    return binary_frame(spark, encode_frame(table(spark, sf_dir, "customer"), CUSTOMER))


@query("SELECT c_custkey::INTEGER AS c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 100")
def row_window(spark, sf_dir):
    ordered = table(spark, sf_dir, "customer").coalesce(1).sortWithinPartitions("c_custkey")  # one file, in key order
    return dataset(ordered, CUSTOMER).rows(100, 25, 0, 2)


@query("SELECT c_acctbal, c_name FROM customer")
def project_columns(spark, sf_dir):
    return dataset(table(spark, sf_dir, "customer"), CUSTOMER).columns([3, 1, 3])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_disc, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1, 2")
def agg_on_dta(spark, sf_dir):
    kinds = {"l_orderkey": "long", "l_linenumber": "byte", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_returnflag": "str1", "l_linestatus": "str1"}
    ds = dataset(table(spark, sf_dir, "lineitem"), kinds)
    rows = ds.frame(columns="l_returnflag,l_linestatus,l_quantity,l_discount,l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.avg("l_discount").alias("avg_disc"), F.max("l_extendedprice").alias("max_price"))


@query("SELECT c_mktsegment, n_name, count(*) AS n, max(c_acctbal) AS max_bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2")
def join_filter_on_dta(spark, sf_dir):
    left = dataset(table(spark, sf_dir, "customer"), CUSTOMER).frame(columns="c_nationkey,c_acctbal,c_mktsegment")
    right = dataset(table(spark, sf_dir, "nation"), {"n_nationkey": "byte", "n_name": "str25"}, version=117).frame()
    joined = left.filter("c_acctbal > 0").join(right, left.c_nationkey == right.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("max_bal"))


DOCUMENTS = "SELECT doc_id::INTEGER AS doc_id, text FROM documents"


@query(DOCUMENTS)
def strl_documents(spark, sf_dir):
    return dataset(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "strL"}).frame()


@query(DOCUMENTS)
def strl_documents_v117_be(spark, sf_dir):
    return dataset(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "strL"}, version=117, order=">").frame()


@query(DOCUMENTS)
def strl_documents_joined(spark, sf_dir):
    """A file per partition, however many; pointers hold in their own file."""
    ds = dataset(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "strL"}, version=119, options={"strl": "pointer", "file": True})
    return resolve_long_strings(ds.frame(), ds.long_strings(), ["text"]).drop("_file")


@query(DOCUMENTS)
def strl_documents_many_files(spark, sf_dir):
    """Four files whose pointers have the same values."""
    ds = dataset(table(spark, sf_dir, "documents").repartition(4, "doc_id"), {"doc_id": "long", "text": "strL"}, options={"strl": "pointer", "file": True})
    return resolve_long_strings(ds.frame(), ds.long_strings(), ["text"]).drop("_file")


@query("SELECT count(*) AS n, count(DISTINCT text) AS texts, sum(strlen(text) + 1) AS bytes FROM documents WHERE text <> ''")
def long_strings_frame(spark, sf_dir):
    ds = dataset(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "strL"})
    return ds.long_strings().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"), F.sum(F.octet_length("content")).alias("bytes"))


def _nations(spark, sf_dir) -> dict:
    return {r["n_nationkey"]: r["n_name"] for r in table(spark, sf_dir, "nation").collect()}


@query("SELECT c_custkey::INTEGER AS c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def labels_nation(spark, sf_dir):
    ds = dataset(table(spark, sf_dir, "customer"), CUSTOMER, tables={"nations": _nations(spark, sf_dir)}, value_labels={"c_nationkey": "nations"})
    return ds.with_labels(ds.frame(), ["c_nationkey"]).select("c_custkey", F.col("c_nationkey_label").alias("n_name"))


@query("SELECT 'nations' AS \"table\", n_nationkey AS value, n_name AS label FROM nation")
def value_labels_frame(spark, sf_dir):
    ds = dataset(table(spark, sf_dir, "nation"), {"n_nationkey": "byte"}, version=115, tables={"nations": _nations(spark, sf_dir)})
    return ds.value_labels()


@query("""SELECT l_orderkey::INTEGER AS l_orderkey, l_linenumber::INTEGER AS l_linenumber,
  CASE l_linenumber WHEN 4 THEN 'low' WHEN 5 THEN 'unknown' WHEN 6 THEN 'refused' END AS x_label FROM lineitem""")
def labels_missing_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_linenumber") + 96)  # 101 is `.`
    ds = dataset(rows, {"l_orderkey": "long", "l_linenumber": "long", "x": "byte"}, tables={"codes": {100: "low", 2147483621: "unknown", 2147483622: "refused"}}, value_labels={"x": "codes"})
    return ds.with_labels(ds.frame(missing="tagged"), ["x"]).select("l_orderkey", "l_linenumber", "x_label")


def _missing(storage: str, first: int, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").withColumn("x", F.lit(first - 4) + F.col("l_linenumber"))
        return dataset(rows, {"l_orderkey": "long", "l_linenumber": "long", "x": storage}, version=117 if storage == "int" else 118).frame(missing="tagged")

    QUERIES[f"missing_{storage}"] = run
    ORACLES[f"missing_{storage}"] = f"""SELECT l_orderkey::INTEGER AS l_orderkey, NULL::VARCHAR AS l_orderkey__missing, l_linenumber::INTEGER AS l_linenumber, NULL::VARCHAR AS l_linenumber__missing,
  CASE WHEN l_linenumber < 4 THEN ({first - 4} + l_linenumber)::{kind} END AS x,
  CASE WHEN l_linenumber = 4 THEN '.' WHEN l_linenumber > 4 THEN '.' || chr(92 + l_linenumber) END AS x__missing FROM lineitem"""


_missing("byte", 101, "TINYINT")
_missing("int", 32741, "SMALLINT")
_missing("long", 2147483621, "INTEGER")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k < 0 OR k % 2 <> 0 THEN NULL WHEN k = 0 THEN '.' WHEN k / 2 <= 26 THEN '.' || chr((96 + k / 2)::INTEGER) END AS tag
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 60 - 2 AS k FROM lineitem)""")
def missing_float_bits(spark, sf_dir):
    raw = F.lit(0x7F000000) + (F.col("l_partkey") % 60 - 2) * 0x400
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", float_bits_tag(raw).alias("tag"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN '.' WHEN k <= 26 THEN '.' || chr((96 + k)::INTEGER) END AS tag
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 30 AS k FROM lineitem)""")
def missing_double_bits(spark, sf_dir):
    raw = F.unhex(F.concat(F.lit("0" * 10), F.lpad(F.hex(F.col("l_partkey") % 30), 2, "0"), F.lit("E07F")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", double_bits_tag(raw, True).alias("tag"))


@query("""SELECT l_orderkey::INTEGER AS l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN k > 26 THEN pow(2, 1023) * (1 + k / 4096.0::DOUBLE) END AS x,
  CASE WHEN k = 0 THEN '.' WHEN k <= 26 THEN '.' || chr((96 + k)::INTEGER) END AS x__missing, CASE WHEN k = 0 THEN '.' WHEN k <= 26 THEN '.' || chr((96 + k)::INTEGER) END AS tag
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 30 AS k FROM lineitem)""")
def missing_double(spark, sf_dir):
    # A null of the table is NaN in the file, which is none of the missing values, and null again afterwards.
    x = F.coalesce(F.lit(2.0**1023) * (1 + (F.col("l_partkey") % 30) / 4096), F.lit(float("nan")))
    ds = dataset(table(spark, sf_dir, "lineitem").withColumns({"x": x, "y": x}), {"l_orderkey": "long", "l_linenumber": "long", "x": "double"})
    # The tag that the file gives, and the one that the function gives for the same number.
    rows = ds.frame(missing="struct").select("l_orderkey.value", F.col("l_linenumber.value").alias("l_linenumber"), F.when(~F.isnan("x.value"), F.col("x.value")).alias("x"), F.col("x.missing").alias("x__missing")).withColumnRenamed("value", "l_orderkey")
    code = F.when(F.col("x__missing").isNotNull(), F.lit(2.0**1023) * (1 + F.when(F.col("x__missing") == ".", 0).otherwise(F.ascii(F.substring("x__missing", 2, 1)) - 96) / 4096)).otherwise(F.col("x"))
    return rows.withColumn("tag", missing_tag(code, "double"))


@query("SELECT l_orderkey, l_linenumber, (2147483621 + l_linenumber - 1)::INTEGER AS key FROM lineitem")
def missing_label_key(spark, sf_dir):
    tag = F.when(F.col("l_linenumber") == 1, F.lit(".")).otherwise(F.concat(F.lit("."), F.char(F.col("l_linenumber") + 95)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label_key(tag).alias("key"))


def _shown(name: str, source: str, key: str, value: str, storage: str, fmt: str, sql: str) -> None:
    """A column shown by its format; value is a Spark SQL expression of the number that the file holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(F.col(key), F.expr(value).alias("x"))
        return dataset(rows, {key: "long", "x": storage}, formats={key: "%12.0g", "x": fmt}).displayed()

    QUERIES[name], ORACLES[name] = run, f"SELECT {key}::VARCHAR AS {key}, {sql} AS x FROM {source}"


_shown("fmt_fixed", "lineitem", "l_orderkey", "l_extendedprice", "double", "%12.2f", "format('{:.2f}', l_extendedprice)")
_shown("fmt_fixed_comma", "lineitem", "l_orderkey", "l_extendedprice", "double", "%12.2fc", "format('{:,.2f}', l_extendedprice)")
_shown("fmt_scientific", "orders", "o_orderkey", "o_totalprice", "double", "%16.9e", "printf('%.9e', o_totalprice)")
_shown("fmt_general", "part", "p_partkey", "p_retailprice", "double", "%9.0g", "regexp_replace(p_retailprice::VARCHAR, '\\.0$', '')")
_shown("fmt_general_comma", "orders", "o_orderkey", "o_orderkey * 1000", "double", "%16.0gc", "format('{:,}', o_orderkey * 1000)")
_shown("fmt_fallback", "orders", "o_orderkey", "o_orderkey", "double", "%no", "o_orderkey::VARCHAR")
_shown("fmt_td", "lineitem", "l_orderkey", "datediff(l_shipdate, DATE'1960-01-01')", "long", "%td", "lower(strftime(l_shipdate, '%d%b%Y'))")
_shown("fmt_tc", "events", "event_id", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1960-01-01 00:00:00', ts) / 1000", "double", "%tc", "lower(strftime(ts, '%d%b%Y')) || strftime(ts, ' %H:%M:%S')")
_shown("fmt_tw", "orders", "o_orderkey", "(year(o_orderdate) - 1960) * 52 + least((dayofyear(o_orderdate) - 1) div 7, 51)", "int", "%tw", "year(o_orderdate) || 'w' || (least((dayofyear(o_orderdate) - 1) // 7, 51) + 1)")
_shown("fmt_tm", "orders", "o_orderkey", "(year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1", "int", "%tm", "year(o_orderdate) || 'm' || month(o_orderdate)")
_shown("fmt_tq", "orders", "o_orderkey", "(year(o_orderdate) - 1960) * 4 + quarter(o_orderdate) - 1", "double", "%tq", "year(o_orderdate) || 'q' || quarter(o_orderdate)")
_shown("fmt_ty", "orders", "o_orderkey", "year(o_orderdate)", "int", "%ty", "year(o_orderdate)::VARCHAR")


@query("""SELECT l_orderkey::INTEGER AS l_orderkey, l_linenumber::INTEGER AS l_linenumber, l_quantity::FLOAT AS x, '.' AS y__missing FROM lineitem""")
def scan_float(spark, sf_dir):
    """Storage `float`: values, and the first missing code."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"x": F.col("l_quantity").cast("float"), "y": F.lit(2.0**127).cast("float")})
    ds = dataset(rows, {"l_orderkey": "long", "l_linenumber": "long", "x": "float", "y": "float"})
    return ds.frame(missing="tagged").select("l_orderkey", "l_linenumber", "x", "y__missing")


@query("SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS gone, CASE WHEN l_linenumber = 1 THEN 2147483621 END::INTEGER AS k FROM lineitem")
def missing_predicates(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 1, 101).otherwise(F.col("l_linenumber"))
    cell = F.when(is_missing(raw, "byte"), missing_cell(".", "int")).otherwise(F.struct(raw.cast("int").alias("value"), F.lit(None).cast("string").alias("missing")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    return rows.select("l_orderkey", "l_linenumber", is_missing_cell("cell").alias("gone"), label_key(F.col("cell.missing")).alias("k"))


@query("""SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice) AS price, CASE WHEN l_linenumber = 1 THEN '.a' END AS tag, CASE WHEN l_linenumber = 1 THEN 2147483622 END::INTEGER AS k FROM lineitem""")
def sql_names(spark, sf_dir):
    from ..operators.sql import register_functions

    register_functions(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("marlstone_lineitem")
    return spark.sql("""SELECT l_orderkey, l_linenumber, dta_format(l_extendedprice, '%12.2f') AS price, tag, dta_missing_key(tag) AS k
      FROM (SELECT *, dta_missing_tag(CASE WHEN l_linenumber = 1 THEN 102 ELSE 1 END, 'byte') AS tag FROM marlstone_lineitem)""")


@query("""SELECT * FROM (VALUES (0, 'c_custkey', 'long', 4, 0::BIGINT, 65528, '%12.0g', 'Key', ''), (1, 'c_name', 'str25', 25, 4::BIGINT, 25, '%9s', '', ''),
  (2, 'c_nationkey', 'byte', 1, 29::BIGINT, 65530, '%9.0g', 'Nation', 'nations'), (3, 'c_acctbal', 'double', 8, 30::BIGINT, 65526, '%9.0g', '', ''), (4, 'c_mktsegment', 'str12', 12, 38::BIGINT, 12, '%9s', '', ''))
  t(position, name, storage_type, width, "offset", type_code, format, label, value_label)""")
def variables_frame(spark, sf_dir):
    ds = dataset(table(spark, sf_dir, "customer"), CUSTOMER, formats={"c_custkey": "%12.0g"}, labels={"c_custkey": "Key", "c_nationkey": "Nation"}, value_labels={"c_nationkey": "nations"})
    return ds.variables()


@query("SELECT 119 AS version, 'MSF' AS byteorder, 5 AS nvar, count(*) AS nobs, 'Customers' AS label, 50::BIGINT AS record_width FROM customer")
def dataset_info_frame(spark, sf_dir):
    ds = dataset(table(spark, sf_dir, "customer"), CUSTOMER, version=119, order=">", title="Customers")
    return ds.dataset_info().drop("timestamp", "data_offset")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_on_dta"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
