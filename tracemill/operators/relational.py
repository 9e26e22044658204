"""General operators: joins with order, first and last of a key, diffs, roll-ups, segments. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import ratio


def header_line_join(headers: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Line rows with their header's columns; a line without a header stays, its header columns null."""
    return lines.join(headers, key, "left")


def without_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def with_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def linked_counts(left: DataFrame, right: DataFrame, key: str = "k", left_id: str = "id", right_id: str = "r") -> DataFrame:
    """(left_id, linked, first): how many distinct ids of the right rows share a key with each left id, and the least of them; ids without any aren't there.

    Rows are (id, key) with repeats. Ids that have all their keys in common make a class, and classes are joined, so a key that very many ids share costs one
    row for each pair of classes, never one for each pair of ids. Null keys link nothing.
    """
    keys = lambda df, i: df.filter(F.col(key).isNotNull()).groupBy(i).agg(F.array_sort(F.collect_set(key)).alias("_keys"))
    of_left, of_right = keys(left, left_id), keys(right, right_id)
    counted = of_right.groupBy("_keys").agg(F.count(right_id).alias("_n"), F.min(right_id).alias("_first"))
    each = of_left.select("_keys").distinct().select(F.col("_keys").alias("_own"), F.explode("_keys").alias(key))
    pairs = each.join(counted.select("*", F.explode("_keys").alias(key)), key).select("_own", "_keys", "_n", "_first").distinct()  # two classes may share several keys
    sums = pairs.groupBy(F.col("_own").alias("_keys")).agg(F.sum("_n").alias("linked"), F.min("_first").alias("first"))
    return of_left.join(sums, "_keys").select(left_id, "linked", "first")


def unpivot_cells(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per non-blank cell: the keys, column_index (from 1), column_name, raw_value."""
    cells = F.array(
        *(
            F.struct(F.lit(k).alias("column_index"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("raw_value"))
            for k, c in enumerate(columns, 1)
        )
    )
    return table.select(*keys, F.inline(cells)).filter(F.trim(F.coalesce("raw_value", F.lit(""))) != "")


def multimap(cells: DataFrame, key: str, order: list[str], field: str, value: str) -> DataFrame:
    """(key, facts): field to its values in order, as a map of arrays."""
    grouped = cells.groupBy(key, field).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("_v"))
    entry = F.struct(F.col(field).alias("key"), F.transform("_v", lambda x: x[value]).alias("value"))
    return grouped.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("facts"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def best_with_ties(df: DataFrame, keys: list[str], score: Column, least: float) -> DataFrame:
    """All rows with a key's best score, if it is `least` or more."""
    ranked = df.withColumn("_s", score).withColumn("_n", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("_s"))))
    return ranked.filter((F.col("_n") == 1) & (F.col("_s") >= least)).drop("_n", "_s")


def _padded(n: Column) -> Column:
    """Four digits at least, never fewer than the number has."""
    text = n.cast("string")
    return F.when(n < 1000, F.lpad(text, 4, "0")).otherwise(text)


def numbered(df: DataFrame, keys: list[str], order: list[Column], prefix: str, name: str) -> DataFrame:
    """Ids such as prefix0001, counted in order within each key, whose rows one task sorts. For a whole table see numbered_across."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.concat(F.lit(prefix), _padded(n)))


def place_across(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows' places from 1, in order, within each key (in the whole table without keys): ranges of the order are counted, and each row is placed from its range's offset.

    No task sorts more than a range, however many rows a key has. Rows that tie are placed as they come. The ranges are fixed once by a checkpoint, so that a lost executor's rows
    get the same places again; a cluster without a checkpoint folder is refused.
    """
    context = df.sparkSession.sparkContext
    by = [*(F.col(k) for k in keys), *order]
    ranged = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    if context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise ValueError("set a checkpoint folder that the driver and all executors share")
    held = ranged.checkpoint() if context.getCheckpointDir() else ranged.persist()
    sizes = held.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", *keys, F.coalesce(before, F.lit(0)).alias("_before"))
    if keys:
        later = offsets.filter(F.col("_before") > 0).withColumnsRenamed({k: f"_{k}" for k in keys})  # keys that go on from an earlier range, one a range at most
    else:
        later = offsets
    same = [held["_range"] == F.col("r")] + [held[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    rows = held.join(F.broadcast(later.withColumnRenamed("_range", "r")), condition, "left")  # as many rows as ranges
    n = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) + F.coalesce("_before", F.lit(0))
    return rows.withColumn(name, n).drop("_range", "r", "_before", *(f"_{k}" for k in keys))


def numbered_across(df: DataFrame, order: list[Column], prefix: str, name: str) -> DataFrame:
    """Ids such as prefix0001 over all rows in order, as place_across counts them. An empty table stays empty."""
    return place_across(df, [], order, name).withColumn(name, F.concat(F.lit(prefix), _padded(F.col(name))))


def first_rows_of(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, with their places as _n; each task keeps so many before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most)


def segments(df: DataFrame, keys: list[str], order: list[Column], opens: Column) -> DataFrame:
    """Adds segment: how many opening rows have come so far (0 before the first)."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(window))


def conflicts(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct non-empty value, and the values in order."""
    real = cells.filter(F.trim(F.coalesce(value, F.lit(""))) != "")
    found = real.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return found.filter(F.size("values") > 1)


def record_diff(old: DataFrame, new: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """(keys, change): added, removed, changed or unchanged, by comparing the mark (a content hash)."""
    a = old.select(*keys, F.col(mark).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(mark).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def micro_scores(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall) of array columns of labels; an empty denominator counts as 1."""
    marked = rows.select(
        F.explode(F.array_union(expected, actual)).alias("label"), F.col(expected).alias("_e"), F.col(actual).alias("_a")
    )
    in_e, in_a = F.array_contains("_e", F.col("label")), F.array_contains("_a", F.col("label"))
    sums = marked.groupBy("label").agg(
        F.count_if(in_e & in_a).alias("tp"), F.count_if(~in_e & in_a).alias("fp"), F.count_if(in_e & ~in_a).alias("fn")
    )
    return sums.select(
        "label", "tp", "fp", "fn", ratio("tp", F.col("tp") + F.col("fp"), 1.0).alias("precision"), ratio("tp", F.col("tp") + F.col("fn"), 1.0).alias("recall")
    )


def pack_parts(df: DataFrame, key: str, order: list[str], size: str, most: int, gap: int) -> DataFrame:
    """Adds part (from 1): pieces of a key go in order into parts of at most `most`, with `gap` between pieces; a larger piece stands alone.

    The fold runs over one key's sizes only, as an array of small structs.
    """
    items = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("_size")))).alias("_items"))
    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("held"), F.array().cast("array<long>").alias("parts"))

    def step(state, item):
        fits = (state["held"] >= 0) & (state["held"] + gap + item["_size"] <= most)
        part = F.when(fits, state["part"]).otherwise(state["part"] + 1)
        held = F.when(fits, state["held"] + gap + item["_size"]).otherwise(item["_size"])
        return F.struct(part.alias("part"), held.alias("held"), F.concat(state["parts"], F.array(part)).alias("parts"))

    folded = items.select(key, "_items", F.aggregate("_items", start, step, lambda s: s["parts"]).alias("_parts"))
    rows = folded.select(key, F.explode(F.arrays_zip("_items", "_parts")).alias("_z"))
    placed = rows.select(key, *(F.col(f"_z._items.{c}").alias(c) for c in order), F.col("_z._parts").alias("part"))
    return df.join(placed, [key, *order])


def marker_paths(markers: Column) -> Column:
    """Paths of nested paragraph markers such as a, 1, i, A: a marker drops every open one of its level or deeper."""
    level = lambda m: (
        F.when(m.rlike("^[0-9]+$"), 2).when(m.rlike("^[ivx]+$"), 3).when(m.rlike("^[a-z]+$"), 1).otherwise(4)
    )
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("open"), empty.alias("paths"))

    def step(state, m):
        now = F.concat(F.filter(state["open"], lambda o: level(o) < level(m)), F.array(m))
        return F.struct(now.alias("open"), F.concat(state["paths"], F.array(F.concat_ws("/", now))).alias("paths"))

    return F.aggregate(markers, start, step, lambda s: s["paths"])
