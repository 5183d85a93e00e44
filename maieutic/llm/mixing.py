"""op7: mixing sources to target weights by capped water-filling.

``source_targets`` solves the targets: every source wants its weight's share of
the total; a source is clamped at ``max_epochs`` times its size and what it
cannot take is shared out again by weight until no source is above its clamp.
``mix`` then takes documents: ``floor(target / size)`` whole passes over a
source, and for the fraction that remains the documents that come first in a
seeded hash order, up to the word.

No source is ever collected or ordered in one task: the boundary of the
fraction is found by sums over 1,024 hash ranges per source, then over 1,024
ranges inside the boundary range, and only documents of that one range (about a
millionth of the source) are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.llm.common import free_name, written
from maieutic.llm.cutting import row_key

RANGES = 1024


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_weights(sources: DataFrame) -> DataFrame:
    """Add ``weight``: 1, 2, 3 repeating over the sources by code point, null last.

    One row per source comes in (already aggregated), so the single ordered
    window holds the list of source names, not documents.  Spark compares
    strings by their UTF-8 bytes, which is code point order.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))


def source_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Water-filling over ``(source, source_size, weight)``; adds ``target`` (double).

    The level is raised until no open source is above its clamp: each round is
    one aggregate that returns one row of sums, and closes every source that
    the level of the round puts above ``max_epochs * source_size``.  The
    rounds end when none is closed; weights must be positive.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    closed_size, open_weight, closed = 0, None, -1
    level = 0.0
    while True:
        want = F.col("weight") * F.lit(level)
        is_closed = F.lit(False) if closed < 0 else (want > cap)
        row = sources.agg(
            F.coalesce(F.sum(F.when(is_closed, cap)), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~is_closed, F.col("weight"))), F.lit(0)).alias("weight"),
            F.coalesce(F.sum(F.when(is_closed, 1)), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == closed:
            break
        closed, closed_size, open_weight = row["n"], row["size"], row["weight"]
        if not open_weight:
            break
        level = (total - closed_size) / open_weight
    want = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(want > cap, cap.cast("double")).otherwise(want))


def mix(
    docs: DataFrame,
    weights=source_weights,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(<id_col>, row_key, size, source, source_size, target, passes, part, taken)``, one row per input row.

    ``passes`` whole repetitions and ``part`` words of one more (0, the whole
    document, or for one document of a source the words that were still
    missing); ``taken = passes * size + part``.  The taken words of a source
    differ from its target by less than one word.  ``weights`` maps the table
    ``(source, source_size)`` to the same with a positive ``weight``.

    Null text has size 0 and takes nothing; a null source is a source of its
    own; rows with equal ids sit next to each other in the hash order and are
    told apart by ``row_key`` (see ``cutting``), so repeated rows give the same multiset on every run.
    A source of size 0 has target 0.  An empty table gives an empty table.
    """
    # 60 bits of md5('<seed>:<id>'), which any SQL engine can state.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    unit = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        ).select("id", "row_key", "source", "size", unit.alias("h")),
        "mix-sizes",
    )
    high, low = F.shiftright("h", 50), F.shiftright("h", 40).bitwiseAND(F.lit(RANGES - 1))
    rows = rows.withColumns({"high": high, "low": low})

    per_range = written(rows.groupBy("source", "high").agg(F.sum("size").alias("n")), "mix-ranges")
    sources = per_range.groupBy("source").agg(F.sum("n").alias("source_size"))
    plan = source_targets(weights(sources), max_epochs)
    rate = F.col("target") / F.col("source_size")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(rate), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("passes", passes)
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    plan = written(plan.select("source", "source_size", "target", "passes", "rest"), "mix-plan")

    def boundary(sums: DataFrame, ranged: str, rest: str) -> DataFrame:
        """Per source the range in which the running sum reaches ``rest``, and what is left for it."""
        order = Window.partitionBy("source").orderBy(ranged).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = sums.withColumn("upto", F.sum("n").over(order))
        return (
            upto.where((F.col("upto") >= F.col(rest)) & (F.col("upto") - F.col("n") < F.col(rest)))
            .select("source", F.col(ranged).alias(f"{ranged}_at"), (F.col(rest) - F.col("upto") + F.col("n")).alias(f"{ranged}_rest"))
        )

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left join on the null-safe source; ``right`` has a row per source at most."""
        right = right.withColumnRenamed("source", "of")
        return left.join(right, left["source"].eqNullSafe(right["of"]), "left").drop("of")

    first = boundary(beside(per_range, plan.select("source", "rest")), "high", "rest")
    plan = written(beside(plan, first), "mix-first")
    at_first = beside(rows, plan.select("source", "high_at", "high_rest")).where(F.col("high") == F.col("high_at"))
    second = boundary(at_first.groupBy("source", "low", "high_rest").agg(F.sum("size").alias("n")), "low", "high_rest")
    plan = written(beside(plan, second), "mix-second")

    placed = beside(rows, plan)
    before = (F.col("high") < F.col("high_at")) | ((F.col("high") == F.col("high_at")) & (F.col("low") < F.col("low_at")))
    on_edge = (F.col("high") == F.col("high_at")) & (F.col("low") == F.col("low_at"))
    order = (
        Window.partitionBy("source").orderBy("h", "id", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    columns = ["id", "row_key", "size", "source", "source_size", "target", "passes"]
    edge = placed.where(F.coalesce(on_edge, F.lit(False))).withColumn("upto", F.sum("size").over(order)).select(
        *columns,
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("low_rest") - F.col("upto") + F.col("size"))).alias("part"),
    )
    whole = placed.where(~F.coalesce(on_edge, F.lit(False))).select(
        *columns, F.when(F.coalesce(before, F.lit(False)), F.col("size")).otherwise(F.lit(0)).cast("long").alias("part")
    )
    return whole.unionByName(edge).select(
        F.col("id").alias(id_col), *columns[1:], "part",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it in whole.

    The one document of a source that the mix would take in part is taken in whole if at
    least half of it is due.
    """
    plan = mix(docs, max_epochs=max_epochs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    half = (F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))
    key, row, times, copy = (free_name(docs.columns, n) for n in ("key", "row_key", "times", "copy"))
    often = plan.groupBy(F.col("row_key").alias(row)).agg(F.sum(F.col("passes") + F.when(half, 1).otherwise(0)).cast("int").alias(times))
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).dropDuplicates([key])
    taken = keyed.join(often.where(F.col(times) > 0), F.col(key) == F.col(row))
    repeated = taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
