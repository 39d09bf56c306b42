"""File sources and sinks: CSV with declared or text columns, Parquet, submissions, and their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTIONS = "t_dat date, customer_id string, article_id string, price double, sales_channel_id smallint"


def read_transactions(spark: SparkSession, *paths: str) -> DataFrame:
    """The fact table with declared types; ids stay text, so leading zeros stay."""
    return spark.read.schema(TRANSACTIONS).option("header", True).csv(list(paths))


def read_text_table(spark: SparkSession, *paths: str) -> DataFrame:
    """A dimension with every column as text; types are recovered where used."""
    return spark.read.option("header", True).option("inferSchema", False).csv(list(paths))


def to_parquet(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Zstandard Parquet, sorted inside partitions only, so no shuffle."""
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def split(df: DataFrame, cutoff: str, history_days: int, label_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(history, label) by date alone; the filters reach the scan."""
    day, at = F.col("t_dat"), F.to_date(F.lit(cutoff))
    return df.where((day >= F.date_sub(at, history_days)) & (day < at)), df.where((day >= at) & (day < F.date_add(at, label_days)))


def submission(slate: DataFrame, k: int = 12) -> DataFrame:
    """(customer_id, prediction): the first k items of each user as one text, ids padded to ten digits."""
    padded = F.lpad(F.col("article_id").cast("string"), 10, "0")
    return slate.where(F.col("final_rank") <= k).groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", padded.alias("item")))), lambda x: x["item"]), " ").alias("prediction"))


def merge_submission(base: DataFrame, replacement: DataFrame) -> DataFrame:
    """``base`` with the predictions of ``replacement`` for its users; users outside base are not added."""
    new = replacement.select("customer_id", F.col("prediction").alias("new"))
    return base.join(new, "customer_id", "left").select("customer_id", F.coalesce("new", "prediction").alias("prediction"))


def require_columns(df: DataFrame, **types: str) -> DataFrame:
    """Fails before any work when a column is missing or of another type."""
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in types.items() if have.get(c) != t}
    if wrong:
        raise TypeError(f"columns (wanted, found): {wrong}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fails if a key repeats; one aggregate, one row to the driver."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"{', '.join(keys)} repeat")
    return df


def require_equal(a: DataFrame, b: DataFrame) -> None:
    """Fails unless both bags are equal, by both bag differences."""
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("the relations differ")
