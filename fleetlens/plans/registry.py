"""Registry of queries and their SQL."""

from pyspark.sql import functions as F

from fleetlens.session import run_dir

CASES = {}
_SCHEMAS = {}


class Tables:
    """The sample tables of one folder, read by name."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name):
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def stream(self, name):
        """One table as a stream of its files."""
        schema = getattr(self, name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    def shuffled_stream(self, name, parts=4):
        """One table as a stream of `parts` micro-batches, each with rows from all over the table: most rows are late."""
        table = getattr(self, name)
        path = f"{run_dir(self.spark, 'landed')}/{name}"
        table.repartition(parts, F.xxhash64(*table.columns)).write.parquet(path)
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def ordered_stream(self, name, by, parts=4):
        """One table as a stream of `parts` micro-batches along the number `by`, an expression over its columns."""
        table = getattr(self, name)
        path = f"{run_dir(self.spark, 'landed')}/{name}"
        low, high = table.agg(F.min(by), F.max(by)).first()
        part = F.least(F.floor((by - low) * parts / (high - low + 1)), F.lit(parts - 1))
        for i in range(parts):  # one after the other, as a stream takes files by their time
            table.filter(part == i).coalesce(1).write.mode("append").parquet(path)
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def case(name, sql=None):
    """Register a query; `sql` is None where SQL cannot say the same."""

    def add(fn):
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = (fn, sql)
        return fn

    return add
