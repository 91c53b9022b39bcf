"""Operator 7: mixing sources to target weights by entropy balancing.

Rates ``r`` of documents (how often each is taken) are those closest to 1, in the entropy
``sum(size * (r * log r - r + 1))``, under token constraints: for every key of every margin (a
column such as the source) the taken tokens add up to its target.  The solution is an
exponential tilt, ``r = exp(sum of the multipliers of the document's keys)``; the multipliers
minimise a convex dual.  ``balance`` finds them by Newton steps with the whole Hessian, which one
aggregate a round takes from the table of cells (distinct key combinations with their tokens).  Up
to ``DENSE_KEYS`` keys (sources, bands) the driver sees it as a matrix; with more it is never
formed: conjugate gradients apply it cell by cell, and the driver sees a few sums a round.

Rounding into copies: documents of one source and size are exchangeable and form a cell.
From the longest size to the shortest, a cell's copies are the rounded rest of what is due so
far, so a source ends within about half of its shortest documents of the target.  Such a
walk has at most as many steps as the longest document has words, whatever the number of
documents.  Within a cell every document gets ``copies // n`` and those first in hash order
one more; the order is found in hash buckets of bounded size, so a cell with a third of all
rows is spread.

Cases: null and blank texts have size 0, take nothing and count for no target; a null source
is a source of its own; a source whose target is 0 takes nothing; repeated rows are separate
documents (equal rows may differ in which one gets the additional copy); an empty table
gives no rows.  Only the id, text and margin columns are read; others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockledger.llm.common import SPACE_WORD, fresh, read, stored

WEIGHTS = (5, 2, 1)          # fixed by the contract, repeating over the ordered sources
MAX_REPEAT = 3
TOLERANCE = 1e-9
LONGEST_STEP = 2.0          # of a multiplier in one Newton step; longer steps are scaled
DENSE_KEYS = 512            # up to so many keys the Hessian is a matrix, beyond that it is applied cell by cell
CG_TOLERANCE = 1e-14        # of the squared residual within a Newton step
CG_ROUNDS = 200
BUCKET_ROWS = 256


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): words of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text, F.lit(SPACE_WORD)).cast("long").alias("size"))


def with_rank(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Number the rows 0.. in ``order`` without one task for all: sorted ranges plus the rows before each."""
    rows = stored(df.orderBy(order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    # one row for each sorted range
    before = (rows.groupBy(part.alias("__p")).count()
              .select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__b")))
    return (rows.withColumn("__p", part).join(F.broadcast(before), "__p")
            .withColumn(name, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__b", "__m"))


def targets(sources: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, at most ``max_repeat`` times the size.

    ``target = min(max_repeat * size, level * weight)``; the level rises over rounds, each one
    aggregate row, until the targets add up to all tokens.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = with_rank(sources, F.col("source").asc_nulls_last(), "sid")
    s = stored(ranked.withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int"))), "sources")
    limit = F.col("source_size") * float(max_repeat)
    total = float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"])
    level, capped = 0.0, -1
    while True:
        full = limit <= F.col("weight") * level
        r = s.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("spent"), F.count(F.when(full, 1)).alias("n"),
                  F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not r["w"] or r["n"] == capped:
            break
        level, capped = (total - r["spent"]) / r["w"], r["n"]
    return s.withColumn("target", F.least(limit, F.col("weight") * level)).drop("weight")


def balance(cells: DataFrame, margins: dict[str, DataFrame], *, tokens: str = "tokens", tolerance: float = TOLERANCE,
            max_rounds: int = 60) -> dict[str, DataFrame]:
    """Multipliers of the dual: for each margin column a table (key, lam).

    ``cells`` has the margin columns (integer keys) and ``tokens``; ``margins`` maps each to a
    table (key, target).  Keys with target 0 get rate 0 (lam null).  Raises if the residual
    stays above ``tolerance`` (targets that contradict each other).
    """
    cells = stored(cells.groupBy(*margins).agg(F.sum(tokens).cast("double").alias("x")).where("x > 0"), "cells")
    start = F.when(F.col("target") > 0, F.lit(0.0))
    parts = [t.select(F.lit(m).alias("margin"), "key", F.col("target").cast("double").alias("target"), start.alias("lam")) for m, t in margins.items()]
    keys = stored(reduce(DataFrame.unionByName, parts), "multipliers")
    if keys.count() <= DENSE_KEYS:
        return _balance_few(cells, keys, margins, tolerance, max_rounds)
    for _ in range(max_rounds):
        rate = F.exp(sum((F.col(f"lam_{m}") for m in margins), F.lit(0.0)))
        tilted = stored(_at_keys(cells, keys, "lam", margins).select(*margins, (F.col("x") * rate).alias("x")).where("x > 0"), "tilted")
        # the gradient is taken - target; the Hessian's diagonal is taken
        taken = _by_key(tilted, F.col("x"), margins).withColumnRenamed("v", "taken")
        live = F.col("lam").isNotNull() & F.col("taken").isNotNull()
        state = stored(keys.join(taken, ["margin", "key"], "left").select(
            "margin", "key", "target", "lam", "taken", F.when(live, F.col("target") - F.col("taken")).otherwise(0.0).alias("r")), "gradient")
        worst = state.agg(F.coalesce(F.max(F.when(live, F.abs(F.col("r")) / F.col("target"))), F.lit(0.0)).alias("o")).first()["o"]
        if worst <= tolerance:
            return {m: state.where(F.col("margin") == m).select("key", "lam") for m in margins}
        step = _newton_step(tilted, state, margins)
        longest = step.agg(F.max(F.abs("step")).alias("s")).first()["s"] or 1.0
        scale = F.lit(min(1.0, LONGEST_STEP / longest))
        keys = stored(state.select("margin", "key", "target", "lam").join(step, ["margin", "key"], "left").select(
            "margin", "key", "target", (F.col("lam") + F.coalesce("step", F.lit(0.0)) * scale).alias("lam")), "multipliers")
    raise RuntimeError(f"balancing did not settle: largest relative residual {worst}")


def _balance_few(cells: DataFrame, keys: DataFrame, margins: dict[str, DataFrame], tolerance: float, max_rounds: int) -> dict[str, DataFrame]:
    """Newton steps with the Hessian as a matrix: at most ``DENSE_KEYS`` keys, whose pairs one aggregate a round sums up."""
    rows = keys.where("target > 0").orderBy("margin", "key").collect()
    target, lam = np.array([r.target for r in rows]), np.zeros(len(rows))
    place = keys.sparkSession.createDataFrame([(r.margin, r.key, i) for i, r in enumerate(rows)], "margin string, key long, i int")
    placed = stored(_at_keys(cells, place, "i", margins).select(*[F.col(f"i_{m}") for m in margins], "x"), "cells")
    pairs = F.inline(F.array(*[F.struct(F.col(f"i_{a}").alias("a"), F.col(f"i_{b}").alias("b")) for a in margins for b in margins]))
    worst = 0.0
    for _ in range(max_rounds):
        given = F.array(*[F.lit(float(v)) for v in lam])
        tilt = F.exp(sum((F.get(given, F.col(f"i_{m}")) for m in margins), F.lit(0.0)))
        hessian = np.zeros((len(rows), len(rows)))
        for a, b, v in placed.select((F.col("x") * tilt).alias("v"), pairs).groupBy("a", "b").agg(F.sum("v")).collect() if rows else []:
            hessian[a, b] = v
        taken = hessian.diagonal()
        gap = np.where(taken > 0, target - taken, 0.0)
        worst = float(np.abs(gap / target).max(initial=0.0))
        if worst <= tolerance:
            found = keys.sparkSession.createDataFrame([(r.margin, r.key, float(v)) for r, v in zip(rows, lam)], "margin string, key long, lam double")
            return {m: t.select("key").join(found.where(F.col("margin") == m).select("key", "lam"), "key", "left") for m, t in margins.items()}
        # margins that cover the same tokens leave a direction without effect: the shortest solution
        step = np.linalg.lstsq(hessian, gap, rcond=1e-13)[0]
        lam += step * min(1.0, LONGEST_STEP / max(float(np.abs(step).max(initial=0.0)), 1e-300))
    raise RuntimeError(f"balancing did not settle: largest relative residual {worst}")


def _at_keys(cells: DataFrame, keys: DataFrame, column: str, margins: Iterable[str]) -> DataFrame:
    """Cells with ``column`` of their keys, as ``<column>_<margin>``."""
    for m in margins:
        cells = cells.join(keys.where(F.col("margin") == m).select(F.col("key").alias(m), F.col(column).alias(f"{column}_{m}")), m)
    return cells


def _by_key(cells: DataFrame, value: Column, margins: Iterable[str]) -> DataFrame:
    """(margin, key, v): ``value`` summed over the cells of every key of every margin, in one aggregate."""
    places = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).cast("long").alias("key")) for m in margins])
    return cells.select(value.alias("v"), F.inline(places)).groupBy("margin", "key").agg(F.sum("v").alias("v"))


def _newton_step(tilted: DataFrame, state: DataFrame, margins: Iterable[str]) -> DataFrame:
    """(margin, key, step): the Hessian's inverse applied to ``r``, by conjugate gradients over the table of cells.

    The Hessian has the taken tokens of every key on its diagonal and those that two keys share beside
    it; it is applied cell by cell and never formed.  With one margin it is diagonal and the first
    iteration is exact.  Each iteration is one aggregate; the driver sees two sums of it.
    """
    live = state.where(F.col("lam").isNotNull() & F.col("taken").isNotNull())
    size = live.count()
    v = stored(live.select("margin", "key", "taken", F.lit(0.0).alias("step"), "r", (F.col("r") / F.col("taken")).alias("p")), "cg")
    rz = first = float(v.agg(F.coalesce(F.sum(F.col("r") * F.col("p")), F.lit(0.0)).alias("s")).first()["s"])
    for _ in range(min(size, CG_ROUNDS)):
        if rz <= CG_TOLERANCE * first:
            break
        applied = _by_key(_at_keys(tilted, v, "p", margins), F.col("x") * sum((F.col(f"p_{m}") for m in margins), F.lit(0.0)), margins)
        h = stored(v.join(applied.withColumnRenamed("v", "hp"), ["margin", "key"]), "cg")
        curve = float(h.agg(F.coalesce(F.sum(F.col("p") * F.col("hp")), F.lit(0.0)).alias("s")).first()["s"])
        if curve <= 0:
            break
        far = F.lit(rz / curve)
        h = h.withColumn("step", F.col("step") + far * F.col("p")).withColumn("r", F.col("r") - far * F.col("hp"))
        new = float(h.agg(F.sum(F.col("r") * F.col("r") / F.col("taken")).alias("s")).first()["s"])
        v = stored(h.select("margin", "key", "taken", "step", "r", (F.col("r") / F.col("taken") + F.lit(new / rz) * F.col("p")).alias("p")), "cg")
        rz = new
    return v.select("margin", "key", "step")


def round_cells(rows: pd.DataFrame, max_repeat: int = MAX_REPEAT) -> pd.DataFrame:
    """Copies of each size of one source: from the longest, the rounded rest of what is due."""
    rows = rows.sort_values("size", ascending=False, kind="stable")
    due, out = 0.0, []
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
        due += n * size * rate
        copies = int(min(n * max_repeat, max(0, round(due / size))))
        due -= copies * size
        out.append(copies)
    return rows.assign(copies=out)[["sid", "size", "n", "copies"]]


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken) for every row."""
    sized = stored(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col).withColumn("row", F.monotonically_increasing_id()), "sizes")
    # (source, size) cells first: the source totals follow from them
    cells = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-cells")
    total = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = stored(targets(total, weights=weights, max_repeat=max_repeat), "targets")
    keyed = cells.join(aims, cells["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    lam = balance(keyed.select("sid", (F.col("n") * F.col("size")).alias("tokens")),
                  {"sid": aims.select(F.col("sid").alias("key"), "target")})["sid"]
    rate = F.coalesce(F.least(F.exp("lam"), F.lit(float(max_repeat))), F.lit(0.0))
    rated = keyed.join(lam.withColumnRenamed("key", "sid"), "sid").withColumn("rate", rate)
    rounded = rated.where("size > 0").select("sid", "size", "n", "rate").groupBy("sid").applyInPandas(
        lambda g: round_cells(g, max_repeat), "sid long, size long, n long, copies long")
    done = stored(rated.join(rounded.drop("n"), ["sid", "size"], "left").select(
        "source", "sid", "size", "n", "source_size", "target", "rate", F.coalesce("copies", F.lit(0)).alias("copies")), "copies")
    # rows of one size without an id are alike: any order of them will do, and their number spreads them over the buckets
    place = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))
    rows = (sized.join(done, sized["source"].eqNullSafe(done["source"]) & (sized["size"] == done["size"]))
            .select("id", sized["source"], sized["size"], "sid", "n", "source_size", "target", "rate", "copies", place.alias("h")))
    # hash buckets of about BUCKET_ROWS rows within a cell; only ranks inside a bucket need its rows together
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.withColumn("b", F.floor((F.col("h").cast("double") / 2.0 ** 64 + 0.5) * buckets).cast("long"))
    cell = ["sid", "size"]
    counts = rows.groupBy(*cell, "b").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select(*cell, "b", (F.sum("c").over(Window.partitionBy(*cell).orderBy("b")) - F.col("c")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*cell, "b").orderBy("h", "id")) + F.col("before")
    more = (rank <= F.col("copies") % F.col("n")).cast("long")
    own = F.floor(F.col("copies") / F.col("n")) + more
    return (rows.join(before, [*cell, "b"]).withColumn("own", own)
            .select("id", "source", "size", "source_size", "target", "rate", F.col("own").alias("copies"),
                    (F.col("own") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: every document as many times as the plan takes it, all columns, plus ``mix_copy`` 1, 2, ... (replaces a column of that name)."""
    got = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, max_repeat=max_repeat)
    k, c, t = (fresh(docs.columns, x) for x in ("key", "copies", "times"))
    # rows that share id, source and size are exchangeable: they share their copies
    key = got.groupBy("id", "source", "size").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("m"))
    taken = key.where("all > 0").select(F.struct("id", "source", "size").alias("k"), F.struct("all", "m").alias(c))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.withColumn(k, F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                      F.regexp_count(text, F.lit(SPACE_WORD)).cast("long").alias("size")))
    joined = own.join(taken, own[k].eqNullSafe(taken["k"])).drop(taken["k"])
    nth = F.row_number().over(Window.partitionBy(k).orderBy(F.xxhash64(text_col)))
    times = F.floor(F.col(f"{c}.all") / F.col(f"{c}.m")) + (nth <= F.col(f"{c}.all") % F.col(f"{c}.m")).cast("long")
    again = joined.withColumn(t, times).where(F.col(t) > 0)
    number = F.explode(F.sequence(F.lit(1), F.col(t).cast("int"))).alias("mix_copy")
    return again.select(*[x for x in docs.columns if x.lower() != "mix_copy"], number)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return plan(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
