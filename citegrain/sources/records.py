"""Readers and writers of entities, record arrays, CSV of several dialects, id lists and histograms.

Readers take paths that Spark reads; only write-side release files (xz) go through the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.functions import ids
from citegrain.storage import exists, file_system


def read_entity(spark: SparkSession, root: str, entity: str, schema: T.StructType | str) -> DataFrame:
    """All JSON-lines files of an entity: a directory, whatever lies below it. Absent fields are null."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{root.rstrip('/')}/{entity}")


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, sep: str = ",", schema: str | None = None, infer: bool = False, skip: int = 0) -> DataFrame:
    """A CSV with a header: all strings unless a schema is given or to be inferred (a pass of its own over the
    rows), a byte-order mark is skipped, and missing columns are an error. The first `skip` lines of each
    file are left out; then a field can't hold a line break."""
    reader = spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
    if skip:
        # lines of a file are numbered where it is read as one split; lineSep makes records of lines
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        first = lines.where("b = 0").groupBy("f").agg(F.min("i").alias("least"))
        kept = lines.join(F.broadcast(first), "f").where((F.col("b") > 0) | (F.col("i") >= F.col("least") + skip))
        header = kept.where((F.col("b") == 0) & (F.col("i") == F.col("least") + skip)).select("value").first()
        if header is None:
            raise ValueError(f"{path} has no header line")
        names = [c.strip('"').lstrip("\ufeff") for c in header[0].split(sep)]
        ddl = ", ".join(f"`{c}` string" for c in names)
        rows = kept.where((F.col("b") > 0) | (F.col("i") > F.col("least") + skip)).where(F.trim("value") != "")
        df = rows.select(F.from_csv("value", schema or ddl, {"sep": sep, "escape": '"'}).alias("r")).select("r.*")
    else:
        reader = reader.option("multiLine", "true")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", str(infer).lower())).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    if missing := sorted(set(required or []) - set(df.columns)):
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return df


def read_preamble_csv(spark: SparkSession, path: str, tokens: tuple[str, ...] = ("Journal name", "ISSN", "JIF")) -> DataFrame:
    """A CSV whose header comes after a preamble: it is the first line that holds all tokens. A percent
    sign behind a closing quote is moved inside it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r'"([^"]*)"%', r'"$1%"').alias("value"))
    header = lines.where(" AND ".join(f"contains(value, '{t}')" for t in tokens)).first()
    if header is None:
        raise ValueError(f"{path} has no header line")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in spark.createDataFrame([(header[0],)], "h string").select(F.from_csv("h", ", ".join(f"c{i} string" for i in range(header[0].count(",") + 1))).alias("r")).select("r.*").first() if c])
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    rows = lines.where((F.col("value") != header[0]) & (F.trim("value") != ""))
    return rows.select(F.from_csv("value", ddl, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def metric_columns(columns: list[str], *names: str) -> dict[str, str | None]:
    """For each name the column `20xx NAME`, else `NAME`, else none."""
    return {n: next((c for c in columns if re.fullmatch(rf"20\d\d {n}", c)), n if n in columns else None) for n in names}


def read_records(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """A JSON array of records from the first path that exists: .json or .json.gz by Spark; .json.xz,
    for which Hadoop has no codec, in one task."""
    for path in paths:
        if not exists(spark, path):
            continue
        if not path.endswith(".xz"):
            return (spark.read.schema(schema) if schema else spark.read).option("multiLine", "true").json(path)
        if not schema:
            raise ValueError("an xz file needs a schema")
        # one task, as xz can't be split; records go on in batches, so only the file is held whole
        lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_xz_records, "json string")
        return lines.select(F.from_json("json", _ddl(schema)).alias("r")).select("r.*")
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def _ddl(fields: str) -> str:
    """`a:int,b:string` as `a int, b string`."""
    return ", ".join(" ".join(f.strip().split(":", 1)) for f in fields.split(","))


def _xz_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a JSON array, a line each: the file is decompressed and parsed as it is read."""
    import io
    import json
    import lzma

    decoder = json.JSONDecoder()
    for batch in batches:
        for content in batch.column(0):
            text, out = "", []
            with lzma.open(io.BytesIO(content.as_py()), "rt", encoding="utf-8") as f:
                first = True
                while piece := f.read(1 << 20):
                    text += piece
                    while True:
                        text = text.lstrip("[, \t\r\n" if first else ", \t\r\n")
                        first = first and not text
                        if not text or text[0] == "]":
                            break
                        try:
                            _, end = decoder.raw_decode(text)
                        except json.JSONDecodeError:
                            break  # the record goes on in the next piece
                        out.append(text[:end])
                        text = text[end:]
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["json"])
                            out = []
            if text.strip() not in ("", "]"):
                raise ValueError("the array of records is cut off")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["json"])


def read_ids(lines: DataFrame) -> DataFrame:
    """(id, n) of a list of ids: blank lines go, others are normalised, and one that can't be is an error
    with its line; each id once, in the order of its number."""
    numbered = lines.select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")).where("value <> ''")
    bad = F.raise_error(F.concat(F.lit("not an id, line "), (F.col("line") + 1).cast("string"), F.lit(": "), F.col("value")))
    one = numbered.select(F.coalesce(ids.work_id(F.col("value")), bad.cast("string")).alias("id")).distinct()
    return one.withColumn("n", F.substring("id", 2, 30).cast("bigint")).orderBy("n")


def read_histogram(spark: SparkSession, path: str, flag: str) -> tuple[DataFrame, str]:
    """(rows, SHA-256): the histogram's keys, n and one flag, and a checksum of its rows in key order."""
    df = read_csv(spark, path, ["field", "year", "cites", "n", flag])
    rows = df.select(*[F.col(c).cast("bigint").alias(c) for c in ("field", "year", "cites", "n", flag)])
    return rows, histogram_checksum(rows, flag).first()["sha256"]


def histogram_checksum(rows: DataFrame, flag: str) -> DataFrame:
    """A checksum of rows that doesn't depend on their order or files: the hash of hashes per stratum."""
    keys = ("field", "year", "cites", "n", flag)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in keys])
    strata = rows.groupBy("field", "year").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return strata.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "year", "h"))), lambda x: x["h"]), "\n"), 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls are empty."""
    df.write.option("header", "true").option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def done_keys(spark: SparkSession, path: str) -> list[str]:
    """The keys whose folder is there whole: each has a mark, which is written after its rows."""
    if not exists(spark, f"{path}/_done"):
        return []
    fs, p = file_system(spark, f"{path}/_done")
    return sorted(unquote(s.getPath().getName()) for s in fs.listStatus(p))


def write_by(df: DataFrame, path: str, key: str) -> list[str]:
    """A folder for each key, as text; keys that are done already stay as they are, what an interrupted run
    left of others is replaced, and the keys that were written come back. Their number is that of the
    folders, so they fit on the driver."""
    spark = df.sparkSession
    text = F.col(key).cast("string")
    done = done_keys(spark, path)
    todo = df.where(~text.isin(done)) if done else df
    keys = sorted(r[0] for r in todo.select(text.alias("k")).where("k IS NOT NULL").distinct().collect())
    if not keys:
        return []
    # overwriting is by folder, so keys that are done aren't touched, and a half-written one is
    todo.where(text.isNotNull()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    for k in keys:
        fs, p = file_system(spark, f"{path}/_done/{quote(k, safe='')}")
        fs.mkdirs(p.getParent())
        fs.create(p, True).close()
    return keys


def complete(spark: SparkSession, path: str, keys: list[str] | None = None) -> bool:
    """Whether an output is there: every key of a divided one is done, or the whole has rows."""
    if keys is not None:
        return set(map(str, keys)) <= set(done_keys(spark, path))
    return exists(spark, path) and not spark.read.parquet(path).isEmpty()


def read_parts(spark: SparkSession, path: str, parts: int, schema: str) -> DataFrame:
    """The rows of part0.json ... of a divided run; a part that is missing is an error."""
    names = [f"{path}/part{i}.json" for i in range(parts)]
    if missing := [n for n in names if not exists(spark, n)]:
        raise FileNotFoundError(", ".join(missing))
    return spark.read.schema(schema).json(names)


def file_checksum(spark: SparkSession, path: str) -> str:
    """The SHA-256 of one file's bytes, as they are stored, read in pieces by the driver."""
    fs, p = file_system(spark, path)
    stream, digest = fs.open(p), hashlib.sha256()
    try:
        while piece := bytes(stream.readNBytes(1 << 20)):
            digest.update(piece)
    finally:
        stream.close()
    return digest.hexdigest()


def dictionary(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(place, column, type, description) of a table's columns; one without a description is an error."""
    if missing := [c for c in df.columns if c not in texts]:
        raise ValueError(f"no description of {', '.join(missing)}")
    rows = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(texts[f.name]).alias("description")) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def write_indexed(df: DataFrame, path: str, order: str, *ids: str) -> None:
    """A table to look rows up in: sorted by one column in ranges, so that files and row groups are left out
    by their least and greatest values, and with a Bloom filter on each of ids."""
    writer = df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite")
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
