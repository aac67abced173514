"""Driver table access.  Reads parquet lazily so Catalyst prunes columns and
pushes filters into the scan; nothing here materialises data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_SCHEMAS: dict = {}


class Tables:
    """Lazy handle on the driver's parquet tables in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise AttributeError(name)
        # the file's schema is read once per (session, file); every use gets a
        # fresh relation (distinct attribute ids, so self-joins stay unambiguous)
        path = f"{self.sf_dir}/{name}.parquet"
        key = (id(self.spark), path)
        schema = _SCHEMAS.get(key)
        if schema is None:
            schema = self.spark.read.parquet(path).schema
            _SCHEMAS[key] = schema
        return self.spark.read.schema(schema).parquet(path)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)
