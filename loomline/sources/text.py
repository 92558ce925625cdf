"""Sources: key-value text, tagged lines, records of several lines, journals, archives. Malformed rows are counted or dropped, never raised."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of every line of every file: whole files are split, so numbers are by file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "text"))


def key_value_pairs(lines: DataFrame, text: str = "text") -> DataFrame:
    r"""(key, value) from rows \key\value\key\value; an odd last key goes."""
    parts = F.split(F.col(text), r"\\")  # the first is what stands before the first backslash
    n = F.floor((F.size(parts) - 1) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    pair = F.explode(F.transform(at, lambda k: F.struct(F.get(parts, 2 * k - 1).alias("key"), F.get(parts, 2 * k).alias("value"))))
    return lines.select(pair.alias("pair")).select("pair.*")


def facts(text: Column) -> Column:
    """A map from lines of name=value; of equal names the first counts, lines without = are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.locate("=", x) > 1)
    names = F.transform(lines, lambda x: F.substring_index(x, "=", 1))
    firsts = F.filter(lines, lambda x, i: F.array_position(names, F.substring_index(x, "=", 1)) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.locate("=", x) + 1, F.length(x)).alias("v"))))


def records_of(lines: DataFrame, size: int) -> DataFrame:
    """(path, record, fields): every `size` lines of a file; an incomplete last record is left out."""
    w = F.floor(F.col("line") / size)
    out = lines.groupBy("path", w.alias("record")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return out.where(F.size("rows") == size).select("path", "record", F.transform("rows", lambda r: r["text"]).alias("fields"))


def tagged_lines(lines: DataFrame, carry: str) -> DataFrame:
    """(path, line, key, value, data, carried) of lines "key value data"; lines of one token go, and `carried` is the value of the last line whose key is `carry`."""
    parts = F.split("text", " ", 3)
    rows = lines.select("path", "line", parts[0].alias("key"), F.get(parts, F.lit(1)).alias("value"), F.get(parts, F.lit(2)).alias("data")).where(F.col("value").isNotNull())
    last = F.last(F.when(F.col("key") == carry, F.col("value")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("carried", last)


def edge_list(lines: DataFrame) -> DataFrame:
    """Undirected edges from lines "x y z*x y z", each with the least length.

    Points may stand in quotes and are rounded to a tenth. Comments (//), lines that are malformed or not finite, and
    edges from a point to itself go; malformed_edges counts the second kind.
    """
    rows = _ends(lines).where("whole")
    length = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return rows.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), length.alias("length")).groupBy("a", "b").agg(F.min("length").alias("length"))


def malformed_edges(lines: DataFrame) -> DataFrame:
    """One row: lines, comments, and malformed, the lines that edge_list leaves out as no edge."""
    rows = _ends(lines)
    return rows.agg(F.count("*").alias("lines"), F.count_if("comment").alias("comments"), F.count_if(~F.col("comment") & ~F.col("whole")).alias("malformed"))


def _ends(lines: DataFrame) -> DataFrame:
    def point(s: Column) -> Column:
        inner = F.regexp_replace(F.trim(s), r"^(['\"]?)(.*)\1$", "$2")
        return F.transform(F.split(F.trim(inner), r"\s+"), lambda x: F.round(x.try_cast("double"), 1))

    ends, comment = F.split("text", r"\*"), F.coalesce(F.col("text").startswith("//"), F.lit(False))
    rows = lines.select(comment.alias("comment"), point(F.get(ends, F.lit(0))).alias("p"), point(F.get(ends, F.lit(1))).alias("q"), F.size(ends).alias("n"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = lambda a: (F.size(a) == 3) & F.forall(a, finite)
    return rows.withColumn("whole", F.coalesce(~F.col("comment") & (F.col("n") == 2) & good(F.col("p")) & good(F.col("q")), F.lit(False)))


def journal(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated numbers; rows with a missing or malformed number go."""
    schema = ", ".join(f"{c} double" for c in columns)
    rows = spark.read.schema(schema + ", bad string").option("columnNameOfCorruptRecord", "bad").csv(path, sep="\t", mode="PERMISSIVE")
    whole = F.col("bad").isNull()
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return rows.where(whole).drop("bad")


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, member, content) of the files in zip archives whose names end in suffix; one task reads an archive at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith(suffix) and not m.endswith("/"):
                            yield pa.RecordBatch.from_pydict({"path": [name], "member": [m], "content": pa.array([z.read(m)], pa.binary())})

    return files.mapInArrow(read, "path string, member string, content binary")


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of files whose name matches a glob pattern, at any depth; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
