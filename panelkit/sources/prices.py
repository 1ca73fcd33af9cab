"""Price files: raw CSV in, clean Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw files have one ticker each, named after it. ``Close`` is read past; the adjusted close is the close here.
RAW = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("Adj Close", T.DoubleType()),
        T.StructField("Volume", T.DoubleType()),
    ]
)
COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All CSV files of a glob with their ``filename``. Without a schema the files' headers decide the columns' order."""
    reader = spark.read.option("header", True)
    if schema is None:
        names = reader.csv(path).columns
        kinds = {f.name: f for f in RAW}
        schema = T.StructType([kinds.get(n, T.StructField(n, T.StringType())) for n in names])
    return reader.schema(schema).csv(path).withColumn("filename", F.col("_metadata.file_path"))


def clean_prices(raw: DataFrame) -> DataFrame:
    """Typed, positive, distinct rows; the ticker comes from the folder ``ticker=...`` or else from the file's name."""
    folder = F.regexp_extract("filename", r"/ticker=([^/]+)/[^/]+$", 1)
    # a folder's name is escaped once by the writer and once more in the path
    name = F.when(folder != "", F.try_url_decode(F.try_url_decode(folder))).otherwise(F.try_url_decode(F.regexp_extract("filename", r"([^/]+)\.csv", 1)))
    return (
        raw.select(
            name.alias("ticker"),
            F.to_date("Date").alias("date"),
            F.col("Open").cast("double").alias("open"),
            F.col("High").cast("double").alias("high"),
            F.col("Low").cast("double").alias("low"),
            F.col("Adj Close").cast("double").alias("close"),
            F.col("Volume").cast("bigint").alias("volume"),
        )
        .where("close > 0 AND volume > 0")
        .distinct()
    )


def check_unique(prices: DataFrame) -> DataFrame:
    """The (ticker, date) pairs that have more than one row; none in a proper panel."""
    return prices.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_prices(prices: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet in the order of ticker and date: ranges of tickers, each sorted."""
    ranged = prices.repartitionByRange(partitions, "ticker", "date") if partitions else prices.repartitionByRange("ticker", "date")
    ranged.sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(path)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Parquet without a promised order."""
    features.write.mode("overwrite").parquet(path)


def write_csv_per_ticker(prices: DataFrame, path: str) -> None:
    """CSV files, one folder per ticker."""
    prices.repartition("ticker").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(path)


def etl(spark: SparkSession, raw_path: str, out_path: str) -> DataFrame:
    """Scan, clean, write, and read back: one plan with one shuffle for the distinct rows and one for the order."""
    write_prices(clean_prices(scan_csv(spark, raw_path)), out_path)
    return read_prices(spark, out_path)
