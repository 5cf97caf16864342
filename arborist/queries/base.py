"""Helpers of the query modules: cached views, engines and registration."""

from __future__ import annotations

import glob
import os
from collections import deque
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.plans.lower import Engine, together
from arborist.sources import views
from arborist.xdm import DOCUMENT

Query = Callable[[SparkSession, str], DataFrame]

_engines: dict[tuple, tuple[float, Engine, list[DataFrame]]] = {}
_kept: deque[DataFrame] = deque()

#: Parsed tables kept at a time; the oldest one is given up for a new one.
MOST_KEPT = 3

#: xsl:key declarations of the order documents: name -> (match, use).
KEYS = {"flag": ("line", "@flag"), "part": ("line", "@part")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """A table that a query reads several times, kept until MOST_KEPT later ones are."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    while len(_kept) > MOST_KEPT:
        _kept.popleft().unpersist()
    return df


def parsed(docs: DataFrame) -> DataFrame:
    """The nodes of texts (doc_id, xml), parsed once and kept by document: later steps neither parse nor shuffle them again."""
    from arborist.sources.shred import shred

    spark = docs.sparkSession
    together(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts made of a small file would all be parsed in one task
    nodes = shred(docs.repartition(parts, "doc_id"))[0].repartition(parts, "doc_id").sortWithinPartitions("doc_id", "pre")
    return keep(views.kept(nodes))


def _version(sf_dir: str) -> float:
    """When the tables of a local folder last changed; 0 for other places."""
    files = glob.glob(f"{sf_dir}/*.parquet") + glob.glob(f"{sf_dir}/*.parquet/*")
    return max(map(os.path.getmtime, files), default=0.0)


def engine(spark: SparkSession, sf_dir: str, view: str) -> Engine:
    """The engine over a view, whose elements are kept (on disk where memory is short) until the tables change."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    version = _version(sf_dir)
    if key in _engines and _engines[key][0] != version:
        for rows in _engines.pop(key)[2]:
            rows.unpersist()
    if key not in _engines:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        together(spark)
        made = getattr(views, view)(spark, sf_dir, parts)
        _engines[key] = version, Engine(made.nodes, keys=KEYS, view=made), made.held
    return _engines[key][1]


class Registry:
    """Collects queries and oracles of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def xpath(self, name: str, view: str, text: str, oracle: str, cast: str | None = None) -> None:
        """A query of one XPath expression: (doc_id, pos, value)."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = engine(spark, sf_dir, view).xpath(text)
            value = F.col("value").cast(cast) if cast else F.col("value")
            return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), value.alias("value"))

        self.queries[name], self.oracles[name] = run, oracle

    def table(self, name: str, view: str, rows: str, columns: dict[str, str], oracle: str, casts: dict[str, str] | None = None) -> None:
        """A query of one row expression and column expressions on each item."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = engine(spark, sf_dir, view).table(rows, **columns)
            made = [F.col(c).cast((casts or {})[c]).alias(c) if c in (casts or {}) else F.col(c) for c in columns]
            return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), *made)

        self.queries[name], self.oracles[name] = run, oracle

    def add(self, name: str, oracle: str | None = None):
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return keep


#: Lines with their place in their order, orders' customers and the like, for the oracles.
LINES = """WITH l AS (SELECT *, l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
 count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) """
GEO = """WITH c AS (SELECT n_regionkey AS doc_id, n_nationkey AS nk, n_name, c_custkey, c_name, c_acctbal,
 row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS pos, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rn
 FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation) """
EVENTS = """WITH e AS (SELECT *, user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) """
