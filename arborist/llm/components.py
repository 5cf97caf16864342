"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import cut


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = _minimum(down)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(u, v) edges over longs -> (node, root), root the smallest node reached; nodes without an edge are absent.

    Every round is two grouped minima and two joins over the edges, of which there are never more than at the
    start; rounds grow with the logarithm of a component's size. Stops with an error rather than return an
    unfinished labelling.
    """
    edges = cut(_small(edges.where("u != v")))
    state = _state(edges)
    for _ in range(most_rounds):
        edges = cut(_small(_large(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def survivors(rows: DataFrame, root: str, id_col: str, columns: list[str]) -> DataFrame:
    """The given columns of one row of each root: the one with the smallest id; a null id is beyond all others.

    Rows of one root and id are told apart by a hash of the row; rows of different roots never meet, even
    if their ids are equal or null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    return rows.groupBy(root).agg(F.min_by(row, rank).alias("__llm_row")).select("__llm_row.*")
