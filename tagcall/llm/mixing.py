"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted ``target / source_size`` times.  The whole part of that
is certain; the fractional parts are rounded together: two fractional documents exchange
probability until one is 0 or 1, the other goes on, and what is left of each block meets the
rest of its source at the next level of a reduction tree.  The sum of the probabilities stays
exact, and as neighbours in a block are of like size, so nearly does the sum of words.

Null text: size 0.  Null source: a source of its own, after the others.  A source without words
has target 0.  Rows that repeat id, text and source are rounded as rows of their own.  An empty table gives an
empty result.  Other columns are not read by ``mix``, and ``repeat_to_mix`` keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import free_names, saved, small, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
#: Documents rounded one after another in one block of the tree.
BLOCK = 256
EPS = 1e-9
#: Rows that repeat another which one task makes from their count.
REPEATS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """From rows (source, n, words): rank, weight and target of each source.

    Targets share the sum of all words by weight; one that would pass ``most`` times its
    source's words stops there, and the excess goes to the others by weight.  With sources in
    ascending order of cap / weight, those that stop are a prefix, so one pass finds them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumns({"weight": weight, "cap": F.lit(most) * F.col("words")})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source whose cap is above its share fixes the level of all that follow.
    s = s.withColumn("free", F.min(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("level").alias("at")))).over(everything))
    target = F.when(F.col("free").isNull() | (F.col("cap") / F.col("weight") < F.col("free.ratio")), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("free.at"), F.col("cap")))
    return s.select("source", "n", F.col("words").alias("source_size"), target.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(block: Column, seed: int) -> Column:
    """Round the units (size, doc_id, row, p) of one array, in order; the last may stay fractional."""

    def with_p(unit: Column, p: Column) -> Column:
        return F.struct(unit["size"].alias("size"), unit["doc_id"].alias("doc_id"), unit["row"].alias("row"), p.alias("p"))

    def step(state: Column, unit: Column) -> Column:
        held = state["held"]
        a, b = held["p"], unit["p"]
        total = a + b
        u = _uniform(F.lit(seed), held["row"], unit["row"])
        low = total < 1 - EPS
        # below 1 one of the two gets all, else one gets 1 and the other what is left
        held_wins = F.when(low, u * total < a).otherwise(u * (2 - total) < 1 - b)
        high, rest = F.when(low, total).otherwise(F.lit(1.0)), F.when(low, F.lit(0.0)).otherwise(total - 1)
        p_held, p_unit = F.when(held_wins, high).otherwise(rest), F.when(held_wins, rest).otherwise(high)
        done = (p_held <= EPS) | (p_held >= 1 - EPS)
        first, second = with_p(held, p_held), with_p(unit, p_unit)
        return F.struct(F.when(done, second).otherwise(first).alias("held"), F.concat(state["out"], F.array(F.when(done, first).otherwise(second))).alias("out"))

    start = F.struct(block[0].alias("held"), F.slice(block, 1, 0).alias("out"))
    return F.aggregate(F.slice(block, 2, 1 << 30), start, step, lambda s: F.concat(s["out"], F.array(s["held"])))


def copies(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, row, source, size, source_size, target, copies); docs has doc_id, row, source, size."""
    staged = saved(docs, "mix-sizes")
    sources = saved(source_targets(staged.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))), "mix-sources")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + EPS)
    known = staged.join(sources.withColumns({"base": whole.cast("long"), "p": F.greatest(share - whole, F.lit(0.0)), "source_key": F.xxhash64(F.col("source").isNull(), "source")}), staged["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    known = known.select("doc_id", "row", "source", "source_key", "size", "source_size", "target", "base", "n", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("p")).alias("p"))
    keep = ["source", "source_key", "source_size", "target", "base"]

    fractional = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    final = lambda df: df.where(~fractional).select("doc_id", "row", "source", "size", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))
    out = [final(known)]
    # Level 0: a small source is one block; others split by size class, then by hash.
    open_ = known.where(fractional)
    size_class = F.when(F.col("n") <= block, F.lit(-1)).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int"))
    classes = open_.withColumn("size_class", size_class)
    level, most = 0, None
    while True:
        counts = classes.groupBy("source_key", "size_class").agg(F.count("*").alias("in_class"))
        counts = saved(counts, f"mix-counts-{level}")
        if level:
            most = counts.agg(F.max("in_class")).first()[0] or 0
        slots = F.ceil(F.col("in_class") / block)
        # counts are joined by broadcast, so a hot source's rows meet only once they are dealt to slots
        dealt = classes.join(small(counts, 40), ["source_key", "size_class"]).withColumn("slot", F.pmod(F.xxhash64(F.lit(seed + level), "row"), slots))
        unit = F.struct("size", "doc_id", "row", "p")
        order = F.array_sort(F.collect_list(unit), lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1)).when(a["row"] < b["row"], -1).when(a["row"] > b["row"], 1).otherwise(0))
        blocks = dealt.groupBy("source_key", "size_class", "slot").agg(order.alias("units"), *(F.first(c).alias(c) for c in keep if c != "source_key"))
        rounded = blocks.select(*keep, F.explode(_pivot(F.col("units"), seed + level)).alias("u")).select(*keep, "u.*")
        rounded = saved(rounded, f"mix-level-{level}")
        out.append(final(rounded))
        left = rounded.where(fractional)
        if most is not None and most <= block:
            break
        classes = left.withColumn("size_class", F.lit(0))
        level += 1
    # One document of a source may still be fractional, as the sum of its probabilities is no whole number.
    last = _uniform(F.lit(seed - 1), F.col("row")) < F.col("p")
    out.append(left.select("doc_id", "row", "source", "size", "source_size", "target", (F.col("base") + last.cast("long")).alias("copies")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, row, of, source, size): ``of`` are 128 bits of id, text and source, ``row`` numbers the rows that repeat them.

    Such rows are counted, with map-side combine, and made anew from their count, ``REPEATS`` at a time.
    """
    of = _identity(docs, id_col, text_col, source_col)
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), of.alias("of"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "mix-rows")
    again = saved(sized.groupBy("of").agg(F.count("*").alias("rows")).where("rows > 1"), "mix-repeated")
    if not again.limit(1).count():
        return sized.withColumn("row", F.struct("of", F.lit(1).cast("long").alias("nth")))
    again = small(again, 48)
    one = sized.join(again, "of").groupBy("of", "rows").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size")))
    parts = one.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows", F.lit(REPEATS).cast("long"))).alias("begin")).repartition("of", "begin")
    end = F.least(F.col("begin") + REPEATS - 1, "rows")
    made = parts.select("doc_id", "of", "source", "size", F.explode(F.sequence("begin", end)).alias("nth"))
    rows = sized.join(again.select("of"), "of", "left_anti").withColumn("nth", F.lit(1).cast("long")).unionByName(made)
    return rows.withColumn("row", F.struct("of", "nth")).drop("nth")


def _identity(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    i, t, s = F.col(id_col), F.col(text_col), F.col(source_col)
    return F.struct(F.xxhash64(i, F.lit(0), t, F.lit(1), s).alias("x"), F.xxhash64(F.lit(1), t, F.lit(2), s, F.lit(3), i).alias("y"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row for each document: id, size, source_size, target, taken words, source, copies."""
    out = copies(_sized(docs, id_col, text_col, source_col), seed)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def repeat_to_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: each row, with all its columns, as often as the mix takes it.

    Rows with the same id, text and source are one row here that is taken as often as all of them.
    """
    of, n = free_names(docs, 2)
    taken = copies(_sized(docs, id_col, text_col, source_col), seed).groupBy(F.col("row.of").alias(of))
    taken = saved(taken.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix-taken").where("copies > 0")
    named = docs.withColumn(of, _identity(docs, id_col, text_col, source_col))
    out = named.join(taken.where("rows = 1").select(of, F.col("copies").alias(n)), of)
    again = taken.where("rows > 1").select(of, F.col("copies").alias(n))
    if again.limit(1).count():
        out = out.union(named.join(again, of).dropDuplicates([of]))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(of, n)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
