"""Table sources: Parquet scans, typed CSV, newest JSON snapshot, literal rows, existence probes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """Scan of one Parquet table; ``columns`` become the scan's read schema."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180 rows keyed by header: quoted commas and line ends, doubled quotes, empty fields null."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', nullValue="", emptyValue="", enforceSchema=False)


def csv_flag(column: str) -> Column:
    """Booleans as exports spell them: t or true."""
    return F.lower(F.col(column).cast("string")).isin("t", "true")


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the JSON file whose name sorts last in ``folder``; only names of the others are read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder).select("path")
    last = names.agg(F.max("path")).first()[0]
    return spark.read.json(last, multiLine=True).withColumn("snapshot", F.lit(last))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed relation, such as a dictionary or a list of windows."""
    return spark.createDataFrame(list(rows), schema)


def exists(df: DataFrame) -> bool:
    """Whether a relation has a row at all; reads no more than one."""
    return not df.isEmpty()


def csv_number(column: str, kind: str = "double") -> Column:
    """Numbers as exports spell them: thousands separators out, anything else null."""
    return F.regexp_replace(F.trim(F.col(column)), ",", "").try_cast(kind)


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 with a header; only fields that need quotes have them, nulls are empty."""
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_snapshot(df: DataFrame, folder: str, name: str) -> str:
    """One JSON artifact beside older ones; ``newest_snapshot`` reads the name that sorts last. For results of a few rows."""
    path = f"{folder.rstrip('/')}/{name}"
    df.coalesce(1).write.mode("errorifexists").json(path)
    return path


def reload_all(spark: SparkSession, steps: Sequence[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], folder: str) -> dict[str, str]:
    """Write tables in their order, each a new version beside the old one; a step gets the versions that the steps before it wrote.

    Stops at the first step that fails, so what derives from others comes last and never mixes old versions with new ones. Returns
    each table's new path.
    """
    from staylens.operators.upserts import replace_table

    paths: dict[str, str] = {}
    for name, make in steps:
        written = {n: spark.read.parquet(p) for n, p in paths.items()}
        paths[name] = replace_table(make(written), f"{folder.rstrip('/')}/{name}")
    return paths


def registry(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (name, n_rows) of tables, for the last step of a reload."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def reload_numbered(df: DataFrame, path: str, identity: str = "id") -> str:
    """A new version of a table whose rows are numbered 1 to n anew, and its path.

    Rows are written once with their place in their partition. The sizes of the partitions, one row for each, give the offsets, so
    numbers come without a sort or a single task. Equal inputs may be numbered differently; every version is dense.
    """
    from staylens.operators.upserts import replace_table

    taken = {c.lower() for c in df.columns}
    if identity.lower() in taken:
        raise ValueError(f"the table has a column {identity} already")
    place = next(n for n in ("_place", "_place_", "_place__") if n not in taken)
    spark = df.sparkSession
    staged = spark.read.parquet(replace_table(df.withColumn(place, F.monotonically_increasing_id()), f"{path.rstrip('/')}/staged"))
    part = F.shiftright(F.col(place), 33)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    own = staged.withColumn("_part", part).join(before.select("_part", "_before"), "_part")
    number = F.col("_before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    return replace_table(own.select(number.alias(identity), *df.columns), path)
