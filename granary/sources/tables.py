"""Reading, describing and laying out tables of a dataset, through Spark's readers and Hadoop's file system."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_TYPES = (T.DecimalType,)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def resolve_table(spark: SparkSession, root: str, name: str) -> tuple[str, str] | None:
    """(format, path) of `name` or its snake_case form, as Parquet file or folder, then as CSV; None if absent."""
    for form in dict.fromkeys((name, snake(name))):
        for kind in ("parquet", "csv"):
            for path in (f"{root}/{form}.{kind}", f"{root}/{form}"):
                if exists(spark, path) and (path.endswith(kind) or _holds(spark, path, kind)):
                    return kind, path
    return None


def _holds(spark: SparkSession, folder: str, kind: str) -> bool:
    fs, p = _fs(spark, folder)
    return any(s.getPath().getName().endswith(kind) for s in fs.listStatus(p))


def scan_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame | None:
    """The table, or None where it is missing. Asked columns that it lacks are left out."""
    found = resolve_table(spark, root, name)
    if not found:
        return None
    kind, path = found
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path) if kind == "parquet" else reader.option("header", True).csv(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def from_footers(spark: SparkSession, path: str, *measures: Column) -> DataFrame:
    """Counts and bounds of a Parquet table, answered from its footers where Spark can: COUNT, and MIN and MAX of numbers, flags and dates.

    Timestamps, texts and decimals have no bounds that Spark takes from footers: a table asked for those is
    scanned, that column alone. The table is read by a session of its own, whose settings push aggregates down.
    """
    own = spark.newSession()
    v1 = [x for x in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(*measures)


def answered(spark: SparkSession, path: str, *measures: Column):
    """One row of aggregates, from the footers or, where some file's footer lacks a bound (all its values are null), from a scan."""
    try:
        return from_footers(spark, path, *measures).first()
    except Exception as e:
        if "No min/max found" not in str(e):
            raise
        return spark.read.parquet(path).agg(*measures).first()


def row_counts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """table, rows for each name; null where the table is missing. Parquet tables answer from their footers."""
    rows = []
    for name in names:
        found = resolve_table(spark, root, name)
        if found and found[0] == "parquet":
            n = answered(spark, found[1], F.count(F.lit(1)).alias("n")).n
        else:
            df = scan_table(spark, root, name) if found else None
            n = df.count() if df is not None else None
        rows.append((name, n))
    return spark.createDataFrame(rows, "table string, rows long")


def footer_bounds(spark: SparkSession, root: str, columns: list[tuple[str, str]]) -> DataFrame:
    """table, column, lowest, highest, filled (rows that are not null) of whole-number columns of Parquet tables: one aggregate a table."""
    rows = []
    for table in dict.fromkeys(t for t, _ in columns):
        own = [c for t, c in columns if t == table]
        found = answered(spark, resolve_table(spark, root, table)[1], *[f(c).alias(f"{n}{i}") for i, c in enumerate(own) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
        rows += [(table, c, found[f"lo{i}"], found[f"hi{i}"], found[f"n{i}"]) for i, c in enumerate(own)]
    return spark.createDataFrame(rows, "table string, column string, lowest long, highest long, filled long")


def discover_tables(spark: SparkSession, root: str) -> DataFrame:
    """table, format, bytes of what lies in a dataset's folder."""
    fs, p = _fs(spark, root)
    rows = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        kind = next((k for k in ("parquet", "csv") if name.endswith("." + k) or s.isDirectory() and _holds(spark, s.getPath().toString(), k)), None)
        if kind:
            rows.append((name.removesuffix("." + kind), kind, fs.getContentSummary(s.getPath()).getLength()))
    return spark.createDataFrame(rows, "table string, format string, bytes long")


def preview_page(df: DataFrame, order_by: list[str], offset: int, limit: int) -> DataFrame:
    """A page in a stated order, each row with the table's row count."""
    total = df.select(F.count(F.lit(1)).alias("total_rows"))
    return df.orderBy(*order_by).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def conform(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Exactly the schema's columns, in its order and types; numbers bound for decimals are rounded half-even first."""
    missing, extra = [f.name for f in schema if f.name not in df.columns], [c for c in df.columns if c not in schema.names]
    if missing or strict and extra:
        raise ValueError(f"missing columns {missing}, unexpected columns {extra}")
    return df.select(*[_cast(F.col(f.name), f.dataType).alias(f.name) for f in schema])


def _cast(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return F.bround(c.cast(T.DecimalType(38, min(kind.scale + 8, 18))), kind.scale).cast(kind)
    return c.cast(kind)


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns: extra ones go, missing ones are typed nulls."""
    return df.select(*[(_cast(F.col(f.name), f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def merge_by_name(dfs: list[DataFrame], strategy: str = "union") -> DataFrame:
    """One table of several: with the columns of the first, or of all."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(project(df, dfs[0].schema)) if strategy == "first" else out.unionByName(df, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, columns: list[str], context: str) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{context}: columns {lacking} are missing")
    return df


def add_year_month(df: DataFrame, date_columns: tuple[str, ...] = ("OrderDate", "ReturnDate", "SnapshotDate", "Date")) -> DataFrame:
    """Year and Month from the first of the date columns that the table has."""
    name = next((c for c in date_columns if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of {date_columns} in {df.columns}")
    return df.withColumns({"Year": F.year(name).cast("short"), "Month": F.month(name).cast("short")})


def coerce_nulls(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of no type take the type that the schema declares."""
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(f.name).cast(kinds.get(f.name, T.StringType())).alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in df.schema])


def normalize_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_date(c) for c in columns if c in df.columns})


def write_fact(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str = "snappy", mode: str = "overwrite") -> None:
    """Parquet, one shuffle by partition so that each has few files; the adaptive plan splits a large partition over several tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by)
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv_bulk(df: DataFrame, path: str, max_rows: int = 0) -> None:
    """CSV for bulk loads: header, booleans as 0 and 1, nothing quoted; text with structural characters is an error."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c.rlike(r'[,"\r\n]'), F.raise_error(F.concat(F.lit(f"{f.name} holds a structural character: "), c)).cast("string")).otherwise(c)
        columns.append(c.alias(f.name))
    writer = df.select(*columns).write.mode("overwrite").option("header", True)
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).csv(path)


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a finished copy in the place of the table it was made from."""
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if not fs.rename(target, old) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
        raise OSError(f"could not put {staged} in the place of {path}")
    fs.delete(old, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where the session has none, on one machine, a local one stands in."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-granary-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage as `checkpointed`, through a table: rows are computed once, and columns can be left out when it is read."""
    path = f"{shared_folder(df.sparkSession)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(spark: SparkSession, path: str, target_mb: int = 128, min_files: int = 2, codec: str = "snappy") -> int:
    """Rewrites a table of many small files; returns the number of files it has then. Tables of fewer files stay.

    A partitioned table keeps its folders, each rewritten to files of about the target size.
    """
    fs, p = _fs(spark, path)
    found, sizes, parts = fs.listFiles(p, True), [], set()
    while found.hasNext():
        s = found.next().getPath(), 0
        name = s[0].getName()
        if name.endswith(".parquet"):
            sizes.append(fs.getFileStatus(s[0]).getLen())
            inner = s[0].getParent().toUri().getPath().removeprefix(p.toUri().getPath()).strip("/")
            parts.update(x.split("=")[0] for x in inner.split("/") if "=" in x)
    if len(sizes) < min_files:
        return len(sizes)
    df = spark.read.parquet(path)
    by = [c for c in df.columns if c in parts]
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    n = max(1, -(-sum(sizes) // (target_mb << 20)))
    if by:
        # The rows of a folder come from as many tasks as it has files of the target size, about.
        folders = df.groupBy(*by).agg(F.count("*").alias("_rows"))
        total = df.count()
        share = F.greatest(F.lit(1), F.ceil(F.col("_rows") * n / F.lit(max(1, total)))).cast("int")
        dealt = df.join(F.broadcast(folders.withColumn("_files", share).drop("_rows")), by) if folders.count() <= 100_000 else df.withColumn("_files", F.lit(1))
        dealt = dealt.withColumn("_file", F.floor(F.rand(7) * F.col("_files")).cast("int"))
        dealt.repartition(*by, "_file").drop("_files", "_file").select(df.columns).write.partitionBy(*by).option("compression", codec).parquet(staged)
    else:
        (df.coalesce(n) if n < len(sizes) else df.repartition(n)).write.option("compression", codec).parquet(staged)
    _swap(spark, staged, path)
    left, number = fs.listFiles(p, True), 0
    while left.hasNext():
        number += left.next().getPath().getName().endswith(".parquet")
    return number


def relayout(spark: SparkSession, path: str, layout: str, codec: str = "snappy") -> None:
    """Changes the partitioning to none, year or year_month; Year and Month are derived where they are lacking."""
    by = {"none": [], "year": ["Year"], "year_month": ["Year", "Month"]}[layout]
    df = spark.read.parquet(path)
    if any(c not in df.columns for c in by):
        df = add_year_month(df)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    write_fact(df, staged, by or None, codec)
    _swap(spark, staged, path)


def optimize_layout(df: DataFrame, float32: list[str] = (), sort_columns: list[str] = ()) -> DataFrame:
    """Narrows whole-number columns whose values allow it, listed doubles to floats, and clusters rows by value."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    bounds = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in whole]).first() if whole else {}
    narrow = {}
    for c in whole:
        lo, hi = bounds[c]
        kind = "long" if lo is None else next((k for k, n in (("short", 15), ("int", 31)) if -(1 << n) <= lo and hi < 1 << n), "long")
        if kind != df.schema[c].dataType.simpleString() and not (kind == "long"):
            narrow[c] = F.col(c).cast(kind)
    out = df.withColumns(narrow | {c: F.col(c).cast("float") for c in float32})
    return out.sortWithinPartitions(*sort_columns) if sort_columns else out


def split_columns(df: DataFrame, core: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """A wide table as its core columns and the key with all others."""
    return df.select(*core), df.select(*key, *[c for c in df.columns if c not in core])
