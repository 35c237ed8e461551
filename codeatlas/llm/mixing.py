"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_words, stored

EPS = 1e-9
#: Most sources whose numbers are broadcast; more are joined by shuffle.
MOST_SOURCES = 200_000


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with source_no, the place of source (a column) in ascending order of code points, null last.

    Ranges of sources are numbered side by side; only the ranges' counts meet in one place.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"))
    dealt = stored(dealt, "sources")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("own"), F.min("n").alias("first"))
    earlier = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", "first", earlier.alias("base"))
    return dealt.join(bases, "part").withColumn("source_no", F.col("base") + F.col("n") - F.col("first")).drop("part", "n", "first", "base")


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_no, source_size, target and rate of sizes (source, source_size).

    Sources share all sizes by weights, in turn. None gets more than most times its size; the
    excess is shared again, which is a water level: it rises until no further source is full.
    Each step is one row of sums, so the number of sources has no limit.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double")
    table = stored(ranked(sizes).withColumn("weight", weight), "targets")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * level >= most * F.col("source_size")  # of size 0: always
        sums = table.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if sums[0] is None or sums[0] == n_full or not sums[2]:
            break
        n_full, level = sums[0], (total - sums[1]) / sums[2]
    goal = F.least(most * F.col("source_size"), F.col("weight") * level) if sums[2] else most * F.col("source_size")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return table.withColumn("target", goal.cast("double")).withColumn("rate", rate).drop("weight")


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: move inclusion probabilities p along the null space of the constraints.

    x has a row per unit and a column per balancing variable. Every step keeps the sums of
    x / p0 * p, moves c + 1 open units, and settles one of them at least at 0 or 1; at most c
    units stay open.
    """
    p, c = p.astype(float).copy(), x.shape[1]
    a = x / np.where(p > 0, p, 1)[:, None]
    waiting = np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist()[::-1]
    held: list[int] = []
    draws = iter(())
    while True:
        while waiting and len(held) <= c:
            held.append(waiting.pop())
        if len(held) <= c:
            return np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))
        m = a[held]
        if c == 2:
            u = np.array((m[1, 0] * m[2, 1] - m[2, 0] * m[1, 1], m[2, 0] * m[0, 1] - m[0, 0] * m[2, 1], m[0, 0] * m[1, 1] - m[1, 0] * m[0, 1]))
        else:
            u = np.linalg.svd(m.T)[2][-1]
        size = np.abs(u).max()
        if size <= 1e-12 * max(1.0, np.abs(m).max() ** 2):
            u = np.linalg.svd(m.T)[2][-1]
            size = np.abs(u).max()
        u = u / size
        q = p[held]
        with np.errstate(divide="ignore"):
            up = np.where(u > EPS, (1 - q) / u, np.where(u < -EPS, -q / u, np.inf)).min()
            down = np.where(u > EPS, q / u, np.where(u < -EPS, (q - 1) / u, np.inf)).min()
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(4096).tolist())
            draw = next(draws)
        q = q + (up if draw * (up + down) < down else -down) * u
        p[held] = np.clip(q, 0, 1)
        held = [k for k in held if EPS < p[k] < 1 - EPS]


def small(sources: DataFrame) -> DataFrame:
    """A stored table with a row per source, broadcast up to MOST_SOURCES rows."""
    return F.broadcast(sources) if sources.count() <= MOST_SOURCES else sources


def land(p: np.ndarray, sizes: np.ndarray, goal: float, rng: np.random.Generator, flips: int = 3) -> np.ndarray:
    """The landing phase for the few units that the flight left open.

    The constraint on the count is dropped and the flight goes on with sizes alone; the one unit
    still open then is settled, and up to flips units are changed, each that which brings the sum
    of sizes nearest to goal.
    """
    free = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p = p.copy()
    if len(free) > 1:
        p[free] = flight(p[free], (sizes * p)[free, None], rng)
    p = np.where(p >= 0.5, 1.0, 0.0)
    gap = goal - float(p @ sizes)
    for _ in range(flips):
        left = np.abs(gap - np.where(p > 0, -sizes, sizes))
        k = int(left.argmin())
        if left[k] >= abs(gap):
            break
        gap -= -sizes[k] if p[k] > 0 else sizes[k]
        p[k] = 1 - p[k]
    return p


def _flyer(schema: T.StructType, seed: int, level: int):
    """The flight of one block; that of a source which is one block lands."""

    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)  # small units settle last, so little is left to land
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        size, p = rows["size"].to_numpy(float), rows["p"].to_numpy()
        out = flight(p, np.column_stack([size * p, p]), rng)
        rows["p"] = land(out, size, float(size @ p), rng) if rows["blocks"].iloc[0] == 1 else out
        return rows[schema.names]

    return fly


def balanced(units: DataFrame, per_block: int = 2_000, seed: int = 42) -> DataFrame:
    """Choose units to 0 or 1 by their probability p, balancing size and count in each source.

    units: source_no, key, size, p (no nulls; key orders and spreads the units). Blocks of
    about per_block units of one source fly apart; the at most two open units of each block
    meet in larger blocks, until a source is one block, which lands. A source that holds a
    third of all rows is many blocks. Equal input gives equal output, whatever the partitions.
    """
    schema = T.StructType([f for f in units.schema if f.name in ("source_no", "key", "size", "p")])
    done, level = None, 0
    while True:
        blocks = stored(units.groupBy("source_no").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("blocks")), "blocks")
        spread = units.join(small(blocks), "source_no").withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + level)), "blocks"))
        spread = spread.repartition("source_no", "block")  # by both: a source alone may be most of the rows
        flown = stored(spread.groupBy("source_no", "block").applyInPandas(_flyer(schema, seed, level), schema), "flight")
        whole = flown.filter("p = 0 or p = 1")
        done = whole if done is None else done.unionByName(whole)
        units = flown.filter("p > 0 and p < 1")
        if units.isEmpty():
            return done
        level += 1


def identity(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    """128 bits that tell a row by its id, source and text; rows equal in all three are alike."""
    rest = F.to_json(F.struct(docs[id_col].alias("i"), docs[source_col].alias("s"), docs[text_col].isNull().alias("n")))
    return F.md5(F.concat(rest, F.lit("\n"), F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (1, 2, 3), most: float = 3.0, seed: int = 42, keyed: bool = False) -> DataFrame:
    """Mix the rows of docs so that each source's words come near its target.

    Returns a row per row of docs: id, source, size (words), source_size, target (its
    source's), copies (how often the mix takes the row) and taken (copies * size). Sources in
    code-point order, null last, weigh weights in turn and share all words of docs; a source
    gets at most most times its size. A row is taken floor(target / source_size) times, and
    once more with the rest as probability, chosen by the cube method. Rows without words have
    size 0 and are taken by the same rule. Null texts have no words; null ids are a value like
    another; rows that are equal in id and size are spread by their number, so repeated rows
    are each chosen for themselves; other columns are not read; an empty table gives an empty
    one. No table of sources is held by the driver.
    """
    rows = stored(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"), identity(docs, id_col, text_col, source_col).alias("key")), "sizes")
    table = small(stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "name"), "goals"))
    placed = rows.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    base = F.floor(F.col("rate") + F.lit(EPS)).cast("int")
    placed = placed.withColumn("base", base).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - base))
    open_ = F.col("p") > EPS
    # Rows with equal keys are alike in all that counts: a run of n of them is chosen as n units key/1 ... key/n.
    units = placed.filter(open_).groupBy("source_no", "key", "size", "p").count().select("source_no", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"), "key", "size", "p")
    units = units.select("source_no", F.concat_ws("/", "key", "nth").alias("key"), "size", "p")
    chosen = balanced(units, seed=seed).filter("p = 1").select("source_no", F.substring_index("key", "/", 1).alias("key")).groupBy("source_no", "key").agg(F.count(F.lit(1)).alias("hits"))
    alike = placed.groupBy("source_no", "key").agg(F.count(F.lit(1)).alias("alike")).filter("alike > 1")
    out = _spread(placed, chosen, alike)
    return out if keyed else out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs.

    Rows equal in id, text and source count as one row that is taken as often as all of them.
    """
    taken = mix(docs, id_col, text_col, source_col, keyed=True, **options)
    totals = taken.groupBy("key").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("alike")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("all"), identity(docs, id_col, text_col, source_col).alias("key")).join(totals, "key")
    rows = rows.filter("alike = 1").unionByName(rows.filter("alike > 1").dropDuplicates(["key"]))
    return rows.select("all", F.explode(F.sequence(F.lit(1), "copies"))).select("all.*")


def _spread(placed: DataFrame, chosen: DataFrame, alike: DataFrame) -> DataFrame:
    """Give each row its copies; of rows alike in all, the first hits of them get the extra one."""
    both = placed.join(chosen, ["source_no", "key"], "left").join(alike, ["source_no", "key"], "left")
    one = both.filter("alike is null").withColumn("extra", F.coalesce("hits", F.lit(0)))
    # The first rows of a run of equal ones get its hits.
    run = both.filter("alike is not null").groupBy("source_no", "key", "id", "source", "size", "source_size", "target", "base").agg(F.max(F.coalesce("hits", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("n"))
    run = run.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth")).withColumn("extra", (F.col("nth") <= F.col("hits")).cast("long"))
    columns = ["id", "source", "key", "size", "source_size", "target", "base", "extra"]
    out = one.select(columns).unionByName(run.select(columns))
    copies = (F.col("base") + F.col("extra")).cast("long")
    return out.select("id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
