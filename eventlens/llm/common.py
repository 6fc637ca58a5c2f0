"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventlens.sources.shared import shared_root

#: Bytes -> bytes: A-Z to lower case, every other ASCII byte outside 0-9 and a-z to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: The same words as a pattern for Java's and DuckDB's regex engines.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z lower-cased, cut at ASCII bytes that are no letter or digit."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def blank_words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z lower-cased, cut at ASCII white space (20, 09-0D)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Scratch:
    """Tables written to the shared folder: they cut lineage, and lost executors cost no rework.

    ``keep`` writes a frame as Parquet and reads it back; ``drop`` deletes one that is
    no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.made)}"
        self.made.append(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def forget_shuffles(self) -> None:
        """Lets shuffle files go of frames that are tables by now: Spark removes them when the driver collects garbage."""
        self.spark._jvm.System.gc()
