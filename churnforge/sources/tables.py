"""Table scans and the derived customer table used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema of the derived customer table (FIXTURES.md §5).
CHURN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("urgent_user", T.StringType()),
    T.StructField("in_debt", T.IntegerType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("n_orders", T.IntegerType()),
    T.StructField("max_order", T.DoubleType()),
    T.StructField("acctbal", T.DoubleType()),
    T.StructField("total_text", T.StringType()),
    T.StructField("churn", T.StringType()),
])

ID_COLUMNS = ["customer_id"]
CATEGORICAL = ["segment", "region", "urgent_user"]
NUMERIC = ["in_debt", "tenure", "n_orders", "max_order", "acctbal"]
LABEL = "churn"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_records(spark: SparkSession, path: str, schema: T.StructType,
                 fmt: str = "csv", header: bool = True) -> DataFrame:
    """Scan with a fixed schema: no inference pass over the data.

    CSV keeps the header line out of the data and reads blanks as the
    literal string (" " stays " ", as the raw customer export has it).
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return (reader.option("header", header).option("ignoreLeadingWhiteSpace", False)
                .option("ignoreTrailingWhiteSpace", False)
                .option("mode", "PERMISSIVE").csv(path))
    return reader.format(fmt).load(path)


def churn_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table with churn label derived from orders (FIXTURES.md §5).

    Plan: orders aggregate on o_custkey (partial aggregation absorbs a
    hot customer) -> customer enriched with nation/region, which the planner
    broadcasts by their size -> left join on the customer key. The global
    last order date is a scalar subquery, not a join.
    """
    orders = read_table(spark, sf_dir, "orders",
                        ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    last_date = orders.select(F.max("o_orderdate")).scalar()
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    agg = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("_f"), F.max("o_orderdate").alias("_l"),
        F.count(F.lit(1)).alias("_n"), F.sum("o_totalprice").alias("_t"),
        F.max("o_totalprice").alias("_hi"),
        F.sum(F.when(urgent, 1).otherwise(0)).alias("_u"))
    geo = (read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
           .join(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]),
                 F.col("n_regionkey") == F.col("r_regionkey")))
    cust = read_table(spark, sf_dir, "customer",
                      ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    base = cust.join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    j = base.join(agg, F.col("c_custkey") == F.col("o_custkey"), "left")
    total_text: Column = (
        F.when((F.col("c_custkey") % 97 == 0) | F.col("_t").isNull(), F.lit(" "))
        .otherwise(F.round("_t", 2).cast("decimal(18,2)").cast("string")))
    churn = F.when(F.col("_l").isNull() | (F.col("_l") < last_date - F.expr("INTERVAL 365 DAYS")),
                   F.lit("Yes")).otherwise(F.lit("No"))
    return j.select(
        F.col("c_custkey").cast("long").alias("id"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.when(F.col("_u") > 0, "Yes").otherwise("No").alias("urgent_user"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("in_debt"),
        F.coalesce(F.datediff(F.col("_l"), F.col("_f")), F.lit(0)).cast("int").alias("tenure"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("n_orders"),
        F.coalesce(F.col("_hi"), F.lit(0.0)).cast("double").alias("max_order"),
        F.col("c_acctbal").cast("double").alias("acctbal"),
        total_text.alias("total_text"),
        churn.alias("churn"),
    )
