"""K-d tree sharding in DataFrame functions: recursive splits at distributed weighted medians.

What is placed is a unit: all rows of one text, or a single row where the rows of its text hold more bytes than a leaf.
A unit is a point with integer coordinates from 0 to 4095, linear between the least and the largest value of the
table: logarithm of the size, host and language in alphabetical order (read as numbers behind what all values begin
with), and id. A node with several leaves is split along its widest dimension at the weighted median of its bytes.

Units of over 1 / HEAVY of a leaf go by their coordinate; those at the median's own value, largest first, go left while
they fit. The light ones are then cut where they fill up the left side, and at that value by hash, so neither a hot
host nor large groups of copies unbalance the leaves. Every level counts bytes by node, dimension and value, and by
hash at the cut; both tables are bounded by nodes, and only one row a node reaches the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborist.llm.common import cut

#: Values of a coordinate, and of the hash that splits ties.
GRID, TIES = 4096, 1 << 14
#: A unit of over 1 / HEAVY of a leaf's bytes is placed before the light ones.
HEAVY = 4
#: Rows that one task numbers in a shard.
SLOT_ROWS = 50_000
#: Tables of nodes or of split texts up to this number of rows are broadcast (both are bounded by the number of leaves).
BROADCAST_SPLITS = 50_000
#: Bytes of a name, after those that all names begin with, that give its place.
NAME_BYTES = 6


def _relation(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    found = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return F.broadcast(found) if len(rows) <= BROADCAST_SPLITS else found


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, size, text_crc32, key, host, lang, row) of every row; a null text has size 8 and the checksum of no bytes."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(data) + 8).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("key"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.monotonically_increasing_id().alias("row"),
    )


def _number(name: Column, skip: int) -> Column:
    """The bytes of a name behind the first `skip` as a number, in the names' order."""
    digits = F.rpad(F.hex(F.substring(name.cast("binary"), skip + 1, NAME_BYTES)), 2 * NAME_BYTES, "0")
    return F.conv(digits, 16, 10).cast("double")


def _scaled(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or not high > low:
        return F.lit(0)
    place = F.floor((F.coalesce(value, F.lit(low)) - low) / (high - low) * (GRID - 1) + 0.5)
    return F.least(F.greatest(place, F.lit(0)), F.lit(GRID - 1)).cast("int")


def _name(column: str, low: str, high: str) -> Column:
    skip = len(os.path.commonprefix([low.encode(), high.encode()]))
    of = lambda s: int.from_bytes(s.encode()[skip : skip + NAME_BYTES].ljust(NAME_BYTES, b"\0"), "big")
    return _scaled(_number(F.col(column), skip), float(of(low)), float(of(high)))


def units(rows: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, DataFrame, int, float]:
    """(units, rows with column part, number of leaves, bytes of a leaf) of points.

    A unit is (key, text_crc32, size, part, bytes, dims, u): part is 0 and bytes are those of all rows of the text, or
    part tells the rows of a text apart; u is a hash of the unit.
    """
    spark = rows.sparkSession
    id_kind = rows.schema["id"].dataType.simpleString()
    numeric = id_kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or id_kind.startswith("decimal")
    place = F.col("id").cast("double") if numeric else F.col("id").cast("string")
    ends = ("size", "host", "lang")
    s = rows.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.min(place).alias("id0"), F.max(place).alias("id1"),
        *[f(c).alias(f"{c}{k}") for c in ends for k, f in enumerate((F.min, F.max))],
    ).first()
    if leaves is None:
        leaves = max(1, -(-s.total // target_bytes))
    leaf = s.total / leaves
    texts = ["key", "text_crc32", "size"]
    groups = rows.groupBy(*texts).agg(F.sum("size").alias("bytes"), F.min(F.struct("id", "host", "lang")).alias("first"))
    groups = groups.select(*texts, "bytes", "first.*")
    over = groups.where(F.col("bytes") > leaf).select(*texts, F.lit(True).alias("over"))
    if leaves <= BROADCAST_SPLITS:  # fewer texts than leaves can be over one
        over = F.broadcast(over)
    rows = rows.join(over, texts, "left").withColumn("part", F.when(F.col("over"), F.xxhash64("row")).otherwise(F.lit(0)).cast("bigint")).drop("over")
    if s.total:
        log = lambda c: F.log2(c.cast("double"))
        bound = spark.range(1).select(log(F.lit(s.size0)).alias("a"), log(F.lit(s.size1)).alias("b")).first()
        ids = _scaled(F.col("id").cast("double"), s.id0, s.id1) if numeric else _name("id", s.id0 or "", s.id1 or "")
        dims = F.array(
            _scaled(log(F.col("size")), bound.a, bound.b), _name("host", s.host0, s.host1), _name("lang", s.lang0, s.lang1),
            F.coalesce(ids, F.lit(0)),
        )
    else:
        dims = F.array(*[F.lit(0)] * 4)
    whole = groups.where(F.col("bytes") <= leaf).withColumn("part", F.lit(0).cast("bigint"))
    single = rows.where("part != 0").withColumn("bytes", F.col("size"))
    columns = [*texts, "part", "bytes", "id", "host", "lang"]
    found = whole.select(*columns).unionByName(single.select(*columns))
    return found.select(*texts, "part", "bytes", dims.alias("dims"), F.xxhash64("key", "part").alias("u")), rows, leaves, leaf


def _cuts(here: DataFrame, heavy: float) -> list[tuple]:
    """(node, dim, value, heavy bytes, heavy hash, light value, tie) of every node to be split; here: units with node and left.

    Heavy units of the value go left if they are larger than the given bytes, or as large and their hash is not above
    the given one; light ones of the light value go left up to the tie.
    """
    spark = here.sparkSession
    light = F.when(F.col("bytes") <= heavy, F.col("bytes")).otherwise(0)
    cells = cut(
        here.select("node", "left", "bytes", light.alias("light"), F.posexplode("dims").alias("dim", "value"))
        .groupBy("node", "left", "dim", "value")
        .agg(F.sum("bytes").alias("bytes"), F.sum("light").alias("light"))
    )
    line = Window.partitionBy("node", "dim").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "dim")
    placed = cells.select(
        "*",
        F.sum("bytes").over(line).alias("upto"), F.sum(F.col("bytes") - F.col("light")).over(line).alias("heavies"),
        (F.sum("bytes").over(whole) * F.col("left")).alias("goal"),
        (F.max("value").over(whole) - F.min("value").over(whole)).alias("width"),
    ).where(F.col("upto") >= F.col("goal"))
    first = placed.groupBy("node", "dim", "width").agg(
        F.min_by(F.struct("value", "bytes", "light", "upto", "heavies", "goal"), "value").alias("at")
    )
    chosen = first.groupBy("node").agg(F.max_by(F.struct("dim", "at.*"), F.struct("width", -F.col("dim"))).alias("at")).select("node", "at.*").collect()
    if not chosen:
        return []
    # the heavy units of the median's value: the largest ones that fit
    room = _relation(spark, "node, dim, value, room", [(r.node, r.dim, r.value, r.goal - (r.upto - r.bytes)) for r in chosen])
    big = here.where(F.col("bytes") > heavy).join(room, "node").where(F.get("dims", F.col("dim")) == F.col("value"))
    falling = Window.partitionBy("node").orderBy(F.col("bytes").desc(), "u").rowsBetween(Window.unboundedPreceding, 0)
    fits = big.select("node", "bytes", "u", "room", F.sum("bytes").over(falling).alias("upto")).where(F.col("upto") <= F.col("room"))
    last = {r.node: r["at"] for r in fits.groupBy("node").agg(F.max_by(F.struct("bytes", "u", "upto"), "upto").alias("at")).collect()}
    # the light ones fill up what is left
    wants = []
    for r in chosen:
        fit = last.get(r.node)
        before = r.heavies - (r.bytes - r.light)
        wants.append((r.node, r.dim, r.goal - before - (fit.upto if fit else 0)))
    want = _relation(spark, "node, dim, want", wants)
    filled = cells.join(want, ["node", "dim"]).select("node", "dim", "value", "light", "want", F.sum("light").over(line).alias("upto"))
    at = {
        r.node: r["at"]
        for r in filled.where("upto >= want AND light > 0").groupBy("node").agg(F.min_by(F.struct("value", "light", "upto", "want"), "value").alias("at")).collect()
    }
    inside = [(r.node, r.dim, at[r.node].value, at[r.node].want - (at[r.node].upto - at[r.node].light)) for r in chosen if r.node in at]
    ties = {}
    if inside:
        lights = here.where(F.col("bytes") <= heavy).join(_relation(spark, "node, dim, value, want", inside), "node")
        lights = lights.where(F.get("dims", F.col("dim")) == F.col("value"))
        counts = lights.groupBy("node", "want", _tie().alias("tie")).agg(F.sum("bytes").alias("bytes"))
        run = Window.partitionBy("node").orderBy("tie").rowsBetween(Window.unboundedPreceding, 0)
        near = counts.select("node", "tie", "want", F.sum("bytes").over(run).alias("upto"))
        # the tie with the sum nearest to what is wanted; none at all counts as tie -1
        best = near.groupBy("node").agg(F.min_by(F.struct("tie", "upto", "want"), F.struct(F.abs(F.col("upto") - F.col("want")), "tie")).alias("at"))
        ties = {r.node: (r["at"].tie if abs(r["at"].upto - r["at"].want) <= abs(r["at"].want) else -1) for r in best.collect()}
    out = []
    for r in chosen:
        fit, lit = last.get(r.node), at.get(r.node)
        # without a cut all light ones go left
        out.append((r.node, r.dim, r.value, fit.bytes if fit else "CAST(NULL AS BIGINT)", fit.u if fit else "CAST(NULL AS BIGINT)", lit.value if lit else GRID, ties.get(r.node, -1)))
    return out


def _tie() -> Column:
    return F.pmod("u", F.lit(TIES)).cast("int")


def kd_shards(units: DataFrame, leaves: int, leaf: float) -> DataFrame:
    """The units with column shard, from 0 to leaves - 1, of nearly equal bytes.

    A node of n leaves leaves n // 2 of them to its left side, and the bytes are split in that proportion.
    """
    spark, columns = units.sparkSession, units.columns
    placed = units.withColumn("node", F.lit(0))
    nodes = {0: leaves}  # a node is named by its first leaf
    heavy = leaf / HEAVY
    while any(n > 1 for n in nodes.values()):
        open_ = [(k, f"CAST({n // 2} AS DOUBLE) / {n}") for k, n in nodes.items() if n > 1]
        cuts = _cuts(placed.join(_relation(spark, "node, left", open_), "node"), heavy)
        right = {k: k + n // 2 for k, n in nodes.items() if n > 1}
        if cuts:
            splits = _relation(spark, "node, dim, value, hb, hu, lv, tie, right", [(*c, right[c[0]]) for c in cuts])
            value = F.get("dims", F.col("dim"))
            fits = (F.col("bytes") > F.col("hb")) | ((F.col("bytes") == F.col("hb")) & (F.col("u") <= F.col("hu")))
            big = (value > F.col("value")) | ((value == F.col("value")) & ~F.coalesce(fits, F.lit(False)))
            small = (value > F.col("lv")) | ((value == F.col("lv")) & (_tie() > F.col("tie")))
            goes = F.when(F.col("bytes") > heavy, big).otherwise(small)
            placed = placed.join(splits, "node", "left").select(*columns, F.when(goes, F.col("right")).otherwise(F.col("node")).alias("node"))
        nodes = {a: m for k, n in nodes.items() for a, m in ([(k, n // 2), (k + n // 2, n - n // 2)] if n > 1 else [(k, n)])}
    return placed.select(*columns, F.col("node").cast("int").alias("shard"))


def with_slots(placed: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Numbers each shard's rows gaplessly from 0: blocks of hashed rows are counted, then numbered on their own."""
    largest = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    blocks = max(1, -(-largest // slot_rows))
    rows = placed.withColumn("__block", F.pmod(F.xxhash64("row", "id"), F.lit(blocks)))
    counts = rows.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("shard", "__block").orderBy("id", "row")
    return (
        rows.withColumn("__row", F.row_number().over(inside))
        .join(starts, ["shard", "__block"])
        .withColumn("slot", (F.col("__from") + F.col("__row") - 1).cast("bigint"))
        .drop("__block", "__row", "__from")
    )


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, **columns) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; give the number of leaves, or the bytes that a leaf is to reach.

    Rows of equal texts share a shard unless they hold more bytes than a leaf. Null hosts and languages count as empty
    names, null ids as the least, null texts as empty; repeated rows are kept; an empty table gives no rows.
    """
    rows = cut(points(docs, **columns))
    found, rows, leaves, leaf = units(rows, leaves, target_bytes)
    placed = kd_shards(cut(found), leaves, leaf).select("key", "text_crc32", "size", "part", "shard")
    return with_slots(cut(rows.join(placed, ["key", "text_crc32", "size", "part"]))).select("id", "size", "text_crc32", "shard", "slot")
