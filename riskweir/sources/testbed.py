"""Application, merchant and scored tables derived by rule from the supplied star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweir.operators.cleaning import clean_merchants, model_frame
from riskweir.operators.split import stratified_split, with_hash
from riskweir.schema import ID, LABEL
from riskweir.session import scratch

TIE_BREAK = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

# Closed-form scores standing for the output of two models under three feature configurations.
CONFIG_SIZES = {"lines": 1, "quantity": 2, "value": 3}
MODELS = ("model_a", "model_b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table that is read as fewer splits than there are cores, as one file with one row group is, has its rows dealt out by ``key``.

    A table of many splits stays as it is read and is aggregated before its first shuffle.
    """
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if splits < cores else df


def applications_from(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw applications: one row per line item, several versions per application id.

    ``lines`` may be a stream; the other tables are static. Which sides are broadcast is left to AQE,
    which looks at their real sizes.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("Application ID"), F.col("p_type").alias("product"), F.col("c_mktsegment").alias("industry"),
        F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.col("l_shipdate").alias("applicationDate"),
        F.when(F.col("l_linestatus") == "O", " approved ").otherwise("Declined").alias("Final Decision"),
        F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "no").otherwise("0").alias("isFraud"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("credit-score"),
        (F.col("l_discount") * 10).alias("fraud_score"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("firstTransactionDate"),
        *TIE_BREAK,
    )


def applications_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications_from(dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"), spark, sf_dir)


def merchant_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order with lines: the numbers behind merchants and scores.

    The lines are dealt out by order once: counts by order and supplier, and those by order, are then made where the lines are, without a shuffle of their own.
    """
    needed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")
    lines = needed.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"),
        F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_shipdate").alias("last_ship"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey", "o_custkey", "n_lines", "quantity", "suppliers", "last_ship", "o_orderdate", "o_totalprice",
            "c_acctbal", "c_mktsegment", "r_name", "o_orderpriority", (F.col("returned") >= 2).alias("positive"),
        )
    )


def _id() -> Column:
    return F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))


def merchants_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw merchants: compact column names, text numbers, mixed binary tokens and null tokens."""
    key = F.col("o_orderkey")

    def holes(value: Column, every: int, token: str) -> Column:
        return F.when(key % every == 0, token).otherwise(value)

    return merchant_base(spark, sf_dir).select(
        _id().alias("ID"),
        F.when(F.col("positive"), "Yes").otherwise(" no ").alias("isFraud"),
        holes(F.col("c_acctbal").cast("string"), 5, "NULL").alias("EAScore"),
        holes(F.col("o_totalprice").cast("string"), 43, "").alias("IdentityRank"),
        F.col("n_lines").alias("ReputationLevel"), F.col("quantity").alias("VolumeScore"),
        F.col("suppliers").alias("resultNumber"), F.date_diff("last_ship", "o_orderdate").alias("EmailDays"),
        F.lit(True).alias("IsValid"), holes(F.lit("T"), 6, "null").alias("isconnected"),
        (key % 2).alias("PersonalDevice"), holes(F.when(key % 3 > 0, "Y").otherwise("N"), 4, "NULL").alias("receivingmail"),
        (F.col("o_custkey") % 256).cast("string").alias("AreaCode"),
        holes(F.col("c_mktsegment"), 7, "").alias("DeviceBrowserType"),
        F.col("r_name").alias("ipaddressloccountry"), F.substring("o_orderpriority", 1, 1).alias("Type"),
        F.col("o_orderdate").alias("OpenDate"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model frame: id, label and the fourteen typed features."""
    clean = clean_merchants(merchants_raw(spark, sf_dir))
    return model_frame(clean, check_classes=False)[0]


def store(df: DataFrame, name: str) -> str:
    """Write the frame to the shared folder and give its path.

    Jobs that go over cleaned rows several times start from a stored table instead of repeating the
    joins behind it; it also survives lost executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def stored_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(merchants(spark, sf_dir), "merchants")


def split_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(with_hash(merchants(spark, sf_dir), "__hash"), "merchants")
    return stratified_split(rows, hashed="__hash").drop("__hash")


def train_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_merchants(spark, sf_dir).filter(F.col("split") == "train").drop("split")


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, is_fraud, split, a_lines .. b_value): closed-form scores in [0, 1], some heavily tied."""
    n, volume, total = F.col("n_lines"), F.col("quantity"), F.col("o_totalprice")
    base = merchant_base(spark, sf_dir).select(
        _id().alias(ID), F.col("positive").cast("int").alias(LABEL),
        (1 - F.lit(1.0) / n).alias("a_lines"), (volume / (volume + 100.0)).alias("a_quantity"), (total / (total + 250000.0)).alias("a_value"),
        (n / (n + 8.0)).alias("b_lines"), (1 - F.lit(60.0) / (volume + 60.0)).alias("b_quantity"), (1 - total / (total + 250000.0)).alias("b_value"),
    )
    return stratified_split(stored(base, "scores"))


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, is_fraud, split, model, feature_configuration, n_features, score)."""
    return long_scores(split_scores(spark, sf_dir), "split")


def long_scores(wide: DataFrame, *keep: str) -> DataFrame:
    """One row per id, model and configuration."""
    rows = [
        F.struct(F.lit(f"model_{m}").alias("model"), F.lit(c).alias("feature_configuration"),
                 F.lit(size).alias("n_features"), F.col(f"{m}_{c}").alias("score"))
        for m in ("a", "b") for c, size in CONFIG_SIZES.items()
    ]
    return wide.select(ID, LABEL, *keep, F.explode(F.array(*rows)).alias("r")).select(ID, LABEL, *keep, "r.*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
