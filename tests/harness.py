"""Runs a query and its SQL twin on the same tables and compares rows and types."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

DATA = Path("/root/testdata")

# Names that both engines use for a type family.
FAMILIES = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "int",
    "double": "double", "float": "double", "string": "text", "varchar": "text", "boolean": "boolean",
    "timestamp": "timestamp",
}


def session(app: str = "tabloom") -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def twin(sql: str, sf_dir: str):
    """Columns, type families and rows of a SQL text over the tables of a folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: FAMILIES.get(str(d[1]).lower(), str(d[1]).lower()) for d in result.description}
    return names, kinds, result.fetchall()


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str, limit: int = 3) -> list[str]:
    """What differs between a result and its twin; empty if nothing does."""
    names, kinds, expected = twin(sql, sf_dir)
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for field in df.schema.fields:
        kind = FAMILIES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != kinds[field.name]:
            problems.append(f"type of {field.name}: {kind} against {kinds[field.name]}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, expected)
    if len(got) != len(want):
        problems.append(f"{len(got)} rows against {len(want)}")
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first: {wrong[:limit]}")
    return problems
