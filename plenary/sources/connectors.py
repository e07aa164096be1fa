"""Readers and sinks: CSV, TSV, JSON lines, XML feeds, HTML tables, JDBC, immutable artifacts; a read-only guard."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A table with a header; all columns are strings unless a schema is given. ``sep`` of a tab reads TSV."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_feed(spark: SparkSession, path: str, row_tag: str = "item", schema: str = "title string, link string, pubDate string, description string") -> DataFrame:
    """Items of an RSS or other XML feed."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A relational table, read in parallel by ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_new_csv(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys the CSV table lacks, one a key; how many there were.

    A key that several new rows have goes to the first in the order of all columns.
    """
    from ..operators.relational import distinct_on

    new = distinct_on(df, keys, *df.columns)
    if _exists(df.sparkSession, path):
        new = new.join(read_csv(df.sparkSession, path).select(*keys), keys, "left_anti").select(*df.columns)
    new = new.persist()
    try:
        n = new.count()
        new.write.mode("append").option("header", True).option("escape", '"').csv(path)
    finally:
        new.unpersist()
    return n


def write_artifact(df: DataFrame, path: str) -> str:
    """Write to a folder named by the rows' digest, never over one that exists; its path."""
    from ..operators.replication import row_hash

    # order-free: the sum of the rows' hashes, each row counted
    h = F.conv(F.substring(row_hash(df.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    total, n = df.agg(F.sum(h), F.count(F.lit(1))).first()
    where = f"{path.rstrip('/')}/digest={total or 0}-{n}"
    if not _exists(df.sparkSession, where):
        df.write.mode("errorifexists").parquet(where)
    return where


def html_rows(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, table, row and cells of every table row of every page; malformed markup is read as far as it goes."""

    def run(batches):
        from html.parser import HTMLParser

        import pyarrow as pa

        class Rows(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.table, self.row, self.rows, self.cells, self.cell = -1, -1, [], None, None

            def handle_starttag(self, tag, attrs):
                if tag == "table":
                    self.table, self.row = self.table + 1, -1
                elif tag == "tr" and self.table >= 0:
                    self.row, self.cells = self.row + 1, []
                elif tag in ("td", "th") and self.cells is not None:
                    self.cell = []

            def handle_data(self, data):
                if self.cell is not None:
                    self.cell.append(data)

            def handle_endtag(self, tag):
                if tag in ("td", "th") and self.cell is not None:
                    self.cells.append(" ".join("".join(self.cell).split()))
                    self.cell = None
                elif tag == "tr" and self.cells is not None:
                    self.rows.append((self.table, self.row, self.cells))
                    self.cells = None

        for batch in batches:
            out = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = Rows()
                parser.feed(html or "")
                out += [(i, *r) for r in parser.rows]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "table", "row", "cells"])

    return df.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "id long, `table` int, `row` int, cells array<string>")


def _statements(sql: str) -> list[str]:
    """Statements without comments; quotes are respected."""
    bare = re.sub(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)
    parts = re.split(r";(?=(?:[^']*'[^']*')*[^']*$)", bare)
    return [" ".join(p.split()) if "'" not in p and '"' not in p else p.strip() for p in parts if p.strip()]


#: Words that write.
_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|copy|call|vacuum|replace\s+table|load|set|cache|refresh|msck|optimize)\b", re.I)


def read_only(sql: str) -> list[str]:
    """The statements of ``sql``; raises ValueError if any isn't a plain read."""
    statements = _statements(sql)
    for s in statements:
        unquoted = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "''", s)
        if not re.match(r"\(*\s*(select|with|values|show|describe|explain)\b", unquoted, re.I) or _WRITES.search(unquoted):
            raise ValueError(f"not a read: {s[:80]}")
    return statements
