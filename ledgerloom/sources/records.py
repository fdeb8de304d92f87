"""The run log and its relatives: JSON lines in, projections and dumps out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a record that may be published; everything else stays.
PUBLISHED = ("run_id", "arm", "split", "variant", "repetition", "model", "environment", "enforcement", "corpus_hash", "catalogue_hash", "prompt_hash", "schema_hash", "scores", "calls", "degradation", "document_chars", "training_match")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A log that must be whole: blank lines are skipped, any other line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that parse; the others, and missing files, are left out."""
    marked = T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreMissingFiles", True).json(path)
    return rows.withColumn("_bad", F.col("_corrupt_record").isNotNull()).where("NOT _bad").drop("_bad", "_corrupt_record")


def read_document(spark: SparkSession, path: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """(header as one row, rows of the array) of a JSON file that holds both."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.drop(rows), whole.select(F.explode(rows).alias("_row")).select("_row.*")


def publish(records: DataFrame, allowed: list[str] | tuple[str, ...] = PUBLISHED) -> DataFrame:
    """Only what is on the list, in its order; columns that the list doesn't know never pass."""
    return records.select(*(c for c in allowed if c in records.columns))


def append_both(records: DataFrame, private: str, public: str, allowed: list[str] | tuple[str, ...] = PUBLISHED) -> None:
    """Every record to the private log, its publishable fields to the public one."""
    records.write.mode("append").json(private)
    publish(records, allowed).write.mode("append").json(public)


def dump(header: DataFrame, rows: DataFrame, order: list[str], path: str) -> None:
    """Header and rows as parquet side by side, rows in a range-partitioned total order."""
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    rows.orderBy(*order).write.mode("overwrite").parquet(f"{path}/rows")


def write_examples(examples: DataFrame, path: str) -> None:
    """One JSON object a line; the first line of each file starts with a byte order mark, as fine-tuning services ask for.

    A file holds one partition, whose rows are numbered from 0 in the lower 33 bits of the id that Spark gives them.
    """
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    line = F.to_json(F.struct(*examples.columns))
    examples.select(F.when(first, F.concat(F.lit("\ufeff"), line)).otherwise(line).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
