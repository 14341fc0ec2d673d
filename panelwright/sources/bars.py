"""Daily and intraday bars, fundamentals and the tables around them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.sources.scratch import file_system, materialise

BAR_COLUMNS = ("open", "high", "low", "close", "volume")
FUNDAMENTALS = ("roe", "rev_growth", "profit_growth", "debt_ratio", "pe_ttm", "pb")
GRAINS = (1, 5, 15, 30, 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(df: DataFrame) -> DataFrame:
    """DOUBLE columns as FLOAT."""
    return df.withColumns({c: F.col(f"`{c}`").cast("float") for c, kind in df.dtypes if kind == "double"})


def read_bars(spark: SparkSession, path: str, suffix: str = ".parquet", narrow: bool = False) -> DataFrame:
    """All files of a folder with one file a code, the code taken from the file name. Files may differ in their columns; unreadable ones are skipped; ``narrow`` makes DOUBLE FLOAT."""
    bars = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").option("pathGlobFilter", f"*{suffix}").parquet(path)
    bars = narrowed(bars) if narrow else bars
    code = F.regexp_replace(F.col("_metadata.file_name"), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    return bars.withColumn("code", code)


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Fundamentals from a folder with one file a code: code, date and those of the six columns that the files have."""
    found = read_bars(spark, path)
    return found.select("code", "date", *(c for c in FUNDAMENTALS if c in found.columns))


def read_intraday(spark: SparkSession, path: str, grain: int, min_rows: int = 100) -> DataFrame:
    """Intraday bars of one grain, from files ``{code}_{grain}m.parquet``; codes under ``min_rows`` rows are left out."""
    return min_history(read_bars(spark, path, f"_{grain}m.parquet"), min_rows - 1)


def _file_name(code) -> str:
    """The code as Spark writes it in a folder's name."""
    return "__HIVE_DEFAULT_PARTITION__" if code is None or code == "" else re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", str(code))


def _code_writer(path: str, draft: str, suffix: str):
    """The function for ``mapInArrow`` that saves rows in order of their code, a file a code; a file gets its name when it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        out, code, rows, own = None, None, 0, f"{draft}_{uuid.uuid4().hex}{suffix}"

        def close() -> pa.RecordBatch:
            out.close()
            files.move(f"{folder}/{own}", f"{folder}/{_file_name(code)}{suffix}")
            return pa.RecordBatch.from_pydict({"code": [None if code is None else str(code)], "rows": [rows]}, schema=pa.schema([("code", pa.string()), ("rows", pa.int64())]))

        for batch in batches:
            keys = batch.column("code").dictionary_encode(null_encoding="encode")
            at = keys.indices.to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for first, last in zip(starts[:-1], starts[1:], strict=True):
                if first == last:
                    continue
                here = batch.column("code")[first].as_py()
                if out is None or here != code:
                    if out is not None:
                        yield close()
                    out, code, rows = pq.ParquetWriter(f"{folder}/{own}", batch.schema, filesystem=files), here, 0
                out.write_batch(batch.slice(first, last - first))
                rows += last - first
        if out is not None:
            yield close()

    return write


def write_code_files(bars: DataFrame, path: str, suffix: str = ".parquet") -> None:
    """Save as a folder with one file a code, ``{code}{suffix}``, as ``read_bars`` takes it; tasks write the files, one code after the other.

    The folder must be one that executors reach by Arrow (mounted, HDFS, S3).
    """
    files, folder = file_system(bars.sparkSession, path)
    files.mkdirs(folder)
    rows = bars.repartition("code").sortWithinPartitions("code", *(c for c in ("date",) if c in bars.columns))
    rows.mapInArrow(_code_writer(files.makeQualified(folder).toUri().toString(), f"_{uuid.uuid4().hex}", suffix), "code string, rows long").write.format("noop").mode("overwrite").save()


def code_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """(code, length, modified) of the files ``{code}{suffix}`` in a folder, from their listing; no file is opened, empty ones are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    code = F.regexp_replace(F.element_at(F.split("path", "/"), -1), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    return listed.select(code.alias("code"), "length", F.col("modificationTime").alias("modified"))


def unfinished_codes(universe: DataFrame, files: DataFrame, more_than: int = 1024) -> DataFrame:
    """(code) of the universe without a file of more than so many bytes in ``files`` (as from ``code_files``)."""
    return universe.select("code").distinct().join(files.where(F.col("length") > more_than), "code", "left_anti")


def write_bars(bars: DataFrame, name: str, buckets: int = 64, path: str | None = None) -> None:
    """Save as a table bucketed and sorted by code, so that windows on the code need no exchange; in the warehouse, or in ``path``."""
    writer = bars.write.bucketBy(buckets, "code").sortBy("code", "date").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def materialise_panel(panel: DataFrame, path: str, as_of: str, mode: str, refresh: bool = False) -> DataFrame:
    """The panel stored for ``as_of`` and ``mode``; computed and written if absent or with ``refresh``."""
    spark, target = panel.sparkSession, f"{path}/as_of={as_of}/mode={mode}"
    files, done = file_system(spark, f"{target}/_SUCCESS")
    if refresh or not files.exists(done):
        draft = f"{path}/_{uuid.uuid4().hex}"  # so that a failed write leaves the old panel, and a panel may be derived from what it replaces
        panel.write.parquet(draft)
        files.delete(done.getParent(), True)
        files.mkdirs(done.getParent().getParent())
        files.rename(file_system(spark, draft)[1], done.getParent())
    return spark.read.parquet(target)


def canonical(df: DataFrame, names: Mapping[str, str], numeric: Sequence[str], date: str = "date", times: Sequence[str] = ()) -> DataFrame:
    """Rename the columns that exist, make numbers, dates and timestamps of text (NULL if that fails), drop incomplete rows."""
    df = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    casts = {c: F.col(c).try_cast("double") for c in numeric if c in df.columns}
    if date in df.columns:
        casts[date] = F.col(date).try_cast("date")
    casts |= {c: F.col(c).try_cast("timestamp_ntz") for c in times if c in df.columns}
    return df.withColumns(casts).na.drop("any")


def min_history(bars: DataFrame, more_than: int = 30) -> DataFrame:
    """Codes with more than so many rows."""
    return bars.withColumn("_rows", F.count("*").over(Window.partitionBy("code"))).where(F.col("_rows") > more_than).drop("_rows")


def stale_codes(universe: DataFrame, bars: DataFrame, target: DataFrame) -> DataFrame:
    """Codes of the universe whose last bar is older than the one date in ``target`` (date), or that have none."""
    last = bars.groupBy("code").agg(F.max("date").alias("last"))
    fresh = last.join(target.select(F.max("date").alias("target")), F.col("last") >= F.col("target"), "left_semi")
    return universe.select("code").distinct().join(fresh, "code", "left_anti")


def needs_refresh(loads: DataFrame, today, days: int = 7) -> DataFrame:
    """(code) whose newest ``loaded_at`` lies ``days`` or more back."""
    return loads.groupBy("code").agg(F.max("loaded_at").alias("at")).where(F.datediff(F.lit(today), F.col("at")) >= days).select("code")


def profile(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """A row a column: type, values, NULLs, least, greatest, mean; with the table's date range."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        parts += [F.count(c).alias(f"n_{c}"), F.count_if(F.col(c).isNull()).alias(f"z_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.avg(c).alias(f"m_{c}")]
    one = df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), *parts)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"n_{c}").alias("n"), F.col(f"z_{c}").alias("nulls"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high"), F.col(f"m_{c}").alias("mean")) for c in columns))
    return one.select("first_date", "last_date", F.explode(rows).alias("r")).select("r.*", "first_date", "last_date")


def describe(df: DataFrame, columns: Sequence[str], accuracy: int = 1_000) -> DataFrame:
    """A row a column: count, mean, sd (sample), min, q25, q50, q75, max of its values; NULL and NaN are none.

    Quartiles are exact: the value of rank ceil(q n). A first pass brackets each by sketches, whose size grows with ``accuracy``
    alone; a second counts the values below a bracket and those in it, about 4 / ``accuracy`` of the rows.
    """
    quarters = (0.25, 0.5, 0.75)
    number = lambda c: F.col(f"`{c}`").cast("double")
    df = materialise(df.select(*(F.when(~F.isnan(number(c)), number(c)).alias(f"_{i}") for i, c in enumerate(columns))))
    shares = [x for q in quarters for x in (q - 2 / accuracy, q + 2 / accuracy)]
    parts = []
    for i, c in enumerate(columns):
        x = F.col(f"_{i}")
        parts += [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.when((F.count(x) > 1) & (F.min(x) == F.max(x)), 0.0).otherwise(F.stddev_samp(x)).alias("sd"), F.min(x).alias("min"), F.percentile_approx(x, shares, accuracy).alias("s"), F.max(x).alias("max")).alias(f"_{i}")]
    one = materialise(df.agg(*parts).select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(columns)))))))  # one row a column
    # the least and the greatest of all rank for certain: a bracket holds its quartile, whatever the sketches are off by
    edges = one.select("i", "n", F.posexplode(F.array(*(F.struct(F.lit(q).alias("q"), F.col("s")[2 * k].alias("lo"), F.col("s")[2 * k + 1].alias("hi")) for k, q in enumerate(quarters)))).alias("k", "b")).select("i", "k", F.ceil(F.col("n") * F.col("b.q")).alias("rank"), "b.lo", "b.hi")
    values = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_{i}").alias("v")) for i in range(len(columns))))).alias("x")).select("x.*").where(F.col("v").isNotNull())
    near = values.join(F.broadcast(edges), "i").where(F.col("v") <= F.col("hi"))  # three rows a column
    counts = near.groupBy("i", "k", "rank", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("i", "k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", so_far).where(F.col("v").isNotNull() & (F.col("upto") >= F.col("rank")))
    wide = found.groupBy("i").agg(*(F.min(F.when(F.col("k") == k, F.col("v"))).alias(q) for k, q in enumerate(("q25", "q50", "q75"))))
    return one.join(wide, "i", "left").select("column", "n", "mean", "sd", "min", "q25", "q50", "q75", "max")


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ("code", "date")) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int = 5, order: Sequence[str] = ("code", "date")) -> DataFrame:
    """The last n rows in an order."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def sample_code(bars: DataFrame, seed: int) -> DataFrame:
    """All bars of one code picked at random."""
    one = bars.select("code").distinct().orderBy(F.md5(F.concat("code", F.lit(f"-{seed}"))), "code").limit(1)
    return bars.join(one, "code", "left_semi")


def bars_from_trades(lineitem: DataFrame) -> DataFrame:
    """Daily bars of a supplier's sales: the first and last sale of a day give open and close."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = lineitem.withColumns({"code": F.col("l_suppkey").cast("string"), "date": F.col("l_shipdate").cast("date")})
    return rows.repartition("code").groupBy("code", "date").agg(  # days have few sales: the one exchange and sort serve what runs by code later too
        F.min_by(price * (1 - F.col("l_discount")), at).alias("open"),
        F.max(price * (1 + F.col("l_tax"))).alias("high"),
        F.min(price * (1 - F.col("l_discount") - F.col("l_tax"))).alias("low"),
        F.max_by(price * (1 - F.col("l_tax")), at).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def fundamentals_from_trades(lineitem: DataFrame) -> DataFrame:
    """Quarterly figures of a supplier, dated at the quarter's last day."""
    quarter = F.last_day(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 2))
    sums = lineitem.groupBy(F.col("l_suppkey").cast("string").alias("code"), quarter.alias("date")).agg(
        (100 * F.avg("l_discount")).alias("roe"),
        F.sum("l_extendedprice").alias("revenue"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("profit"),
        (100 * F.avg("l_tax")).alias("debt_ratio"),
        F.try_divide(F.avg("l_extendedprice"), F.sum("l_quantity")).alias("pe_ttm"),
        F.avg("l_quantity").alias("pb"),
    )
    w = Window.partitionBy("code").orderBy("date")
    grow = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    return sums.withColumns({"rev_growth": grow("revenue"), "profit_growth": grow("profit")}).select("code", "date", *FUNDAMENTALS)


def index_from_bars(bars: DataFrame) -> DataFrame:
    """Mean close of all codes by date."""
    return bars.groupBy("date").agg(F.avg("close").alias("close"))
