"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COMMON: dict[str, tuple[tuple[str, ...], str]] = {}


class Tables:
    """Lazy parquet readers for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


_SHARED: dict[tuple, DataFrame] = {}


def shared(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stage hand-off: build a settled table once per session and input folder.

    Price metrics and the tagged catalogue feed many queries; they are written
    once, like a stage output on disk, and read back column-pruned.
    """
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    """Drop the hand-off tables, so the next query pays for building them."""
    _SHARED.clear()


def query(name: str, sql: str | None = None, uses: tuple[str, ...] | list[str] = ()):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may refer to common table expressions."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_common(uses, sql)
        return fn

    return register


def common(name: str, sql: str, uses: tuple[str, ...] | list[str] = ()) -> None:
    """Define a named SQL building block."""
    COMMON[name] = (tuple(uses), sql)


def with_common(names, body: str) -> str:
    """Prefix ``body`` with the building blocks it needs, dependencies first."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in COMMON[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not ordered:
        return body
    parts = [f"{n} AS (\n{COMMON[n][1].strip()}\n)" for n in ordered]
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
