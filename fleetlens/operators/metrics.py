"""Typed metric tables and schema inference for raw metrics."""

from pyspark.sql import functions as F

from fleetlens.schemas import (
    COORDINATOR_METRIC_KEYS,
    DOUBLE_METRIC_KEYS,
    JOB_METRIC_KEYS,
    WORKER_METRIC_KEYS,
)


def field_name(key):
    """Column name of a raw metric key: `key` is a text or a column."""
    if isinstance(key, str):
        name = key.replace(".", "").replace("_", "")
        name = name[len("Status"):] if name.startswith("Status") else name
        return name.replace("JVM", "jvm").replace("CPU", "Cpu")
    name = F.regexp_replace(F.translate(key, "._", ""), "^Status", "")
    return F.replace(F.replace(name, F.lit("JVM"), F.lit("jvm")), F.lit("CPU"), F.lit("Cpu"))


def spec_of(keys, doubles=tuple(DOUBLE_METRIC_KEYS)):
    """(raw key, column, type) of a list of raw keys."""
    return [(k, field_name(k), "double" if k in doubles else "bigint") for k in keys]


JOB_METRICS = spec_of(JOB_METRIC_KEYS)
COORDINATOR_METRICS = spec_of(COORDINATOR_METRIC_KEYS)
WORKER_METRICS = spec_of(WORKER_METRIC_KEYS)


def _typed(col, dtype, strict):
    return col.cast(dtype) if strict else col.try_cast(dtype)


def project_metrics(df, spec, col="metrics", strict=False):
    """Map of raw texts to typed columns. Missing keys give null; bad numbers give null, or an error if strict."""
    typed = {name: _typed(F.element_at(F.col(col), F.lit(raw)), dtype, strict) for raw, name, dtype in spec}
    return df.withColumns(typed).drop(col)


def project_metrics_long(df, keys, spec, order, key="id", value="value", strict=False):
    """The same from long (key, value) rows: one grouping for all metrics, the newest value of a metric wins."""
    wanted = df.filter(F.col(key).isin(*[raw for raw, _, _ in spec]))
    rank = F.struct(*order)
    # the rank is null for other metrics, and max_by ignores null ranks
    last = [
        _typed(F.max_by(F.col(value), F.when(F.col(key) == raw, rank)), dtype, strict).alias(name)
        for raw, name, dtype in spec
    ]
    return wanted.groupBy(*keys).agg(*last)


def bad_metric_values(df, spec, col="metrics"):
    """Condition of rows in which some metric of the spec has a text that is not a number."""
    bad = F.lit(False)
    for raw, _, dtype in spec:
        text = F.element_at(F.col(col), F.lit(raw))
        bad = bad | (text.isNotNull() & text.try_cast(dtype).isNull())
    return bad


def infer_metric_schema(df, key="id", value="value"):
    """One row per observed metric key: field name and type (double if any value has a dot), sorted by name."""
    seen = df.groupBy(F.col(key).alias("raw_key")).agg(F.bool_or(F.col(value).contains(".")).alias("_dot"))
    return seen.select(
        "raw_key",
        field_name(F.col("raw_key")).alias("field_name"),
        F.when(F.col("_dot"), "double").otherwise("bigint").alias("field_type"),
    ).orderBy("field_name", "raw_key")


def long_metrics(df, col="metrics"):
    """One row per entry of the map: the other columns, `raw_key` and `value`. A null or empty map gives none."""
    return df.select(*[c for c in df.columns if c != col], F.explode(col).alias("raw_key", "value"))


def type_metrics_long(rows, registry=None):
    """Typed long form of (…, raw_key, value) rows, for any number of metric keys and on streams too.

    Adds `field_name`, `field_type`, `long_value` and `double_value`; the text stays. The type is that of the registry, a
    frame of (raw_key, field_type), and that of the row's own text if there is none or it doesn't know the key. Texts that
    are no number of the type give null.
    """
    own = F.when(F.col("value").contains("."), "double").otherwise("bigint")
    if registry is None:
        typed = rows.withColumn("field_type", own)
    else:
        known = registry.select("raw_key", F.col("field_type").alias("_type"))
        typed = rows.join(known, "raw_key", "left").withColumn("field_type", F.coalesce("_type", own)).drop("_type")
    return typed.withColumns({
        "field_name": field_name(F.col("raw_key")),
        "long_value": F.when(F.col("field_type") == "bigint", F.col("value").try_cast("bigint")),
        "double_value": F.when(F.col("field_type") == "double", F.col("value").try_cast("double")),
    })


def type_metrics(df, spec=None, col="metrics"):
    """Typed metrics: the wide form of a spec (see `spec_of` and `registered_spec`), the long form without one."""
    return type_metrics_long(long_metrics(df, col)) if spec is None else project_metrics(df, spec, col)


# A registered metric key; `version` is the batch that first saw it or made it a double.
REGISTRY = "raw_key STRING, field_name STRING, field_type STRING, version BIGINT"


def new_metric_keys(rows, registry, version):
    """Registry rows for what (raw_key, value) rows add to a registry: unknown keys, and whole numbers that become doubles."""
    seen = rows.groupBy("raw_key").agg(F.bool_or(F.col("value").contains(".")).alias("_dot"))
    held = registry.groupBy("raw_key").agg(F.bool_or(F.col("field_type") == "double").alias("_double"))
    both = seen.filter("raw_key IS NOT NULL").join(held, "raw_key", "left")
    dot = F.coalesce("_dot", F.lit(False))
    return both.filter(F.col("_double").isNull() | (~F.col("_double") & dot)).select(
        "raw_key",
        field_name(F.col("raw_key")).alias("field_name"),
        F.when(dot, "double").otherwise("bigint").alias("field_type"),
        F.lit(version).cast("bigint").alias("version"),
    )


def registry_at(registry, version=None):
    """One row per metric key as of a version (the newest if none): once a double, a metric stays one."""
    rows = registry if version is None else registry.filter(F.col("version") <= version)
    double = F.bool_or(F.col("field_type") == "double")
    return rows.groupBy("raw_key", "field_name").agg(
        F.when(double, "double").otherwise("bigint").alias("field_type"), F.max("version").alias("version"))


def registered_spec(registry, version=None):
    """Spec of the wide form from a registered version. The columns of a table have to be known to the driver, so this
    reads them; it is an error if two keys have one field name."""
    rows = registry_at(registry, version).orderBy("field_name", "raw_key").toLocalIterator()
    spec = [(r.raw_key, r.field_name, r.field_type) for r in rows]
    names = [name for _, name, _ in spec]
    twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
    if twice:
        raise ValueError(f"metric keys share a field name: {', '.join(twice)}")
    return spec
