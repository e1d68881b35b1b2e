"""Mixing sources to target weights: blocks of words, drawn by source and index. DataFrame functions only.

The words of each source form one stream, cut into blocks of fixed length, of which the last may be shorter. A source's
target is its share of the mix by weight, stopped at `cap` times its size, and gives its slots: whole passes over its
blocks, then as many blocks as the rest needs, the last of them in part. Each slot of a source falls into an output shard
at random, so the counts by shard are one multinomial draw for each source whose total is the source's slots. A shard's
slots of a source follow those of the shards before it; a slot takes the block that a pseudorandom permutation of the
source's blocks, another for each pass, maps it to (the short last block comes last in a pass, so words add up), and
blocks and documents meet in a join by (source, block).

Defined results: a null text counts no words; a null source is a source, last in order; equal doc_ids are rows of their
own; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK = 32
ROWS_PER_BUCKET = 1_000
SLOTS_PER_SHARD = 65_536
#: Places that one window of a prefix sum holds; places are summed in groups of so many first.
WIDE = 4_096
CHUNK = 4_096
#: Slots that one task makes.
SLOTS_PER_TASK = 200_000
SEED = 20_240_607


def permuted(df: DataFrame, name: str, x: str, n: str, *seed: Column) -> DataFrame:
    """df with a pseudorandom permutation of 0..n-1 at x: six Feistel rounds on a grid of at least n cells, walked on while outside.

    Fewer than sqrt(n) + 1 cells are outside, so a walk of 24 steps ends but for a chance of n ** -12. Each round is a
    column of its own: an expression that names the one before twice would make it twice, and six rounds many times over.
    """
    df = df.withColumn("_wide", F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long"))
    df = df.withColumn("_high", F.ceil(F.col(n).cast("double") / F.col("_wide")).cast("long"))
    wide, high = F.col("_wide"), F.col("_high")
    df = df.withColumns({"_l": F.floor(F.col(x) / high).cast("long"), "_r": F.col(x) % high})
    for k in range(3):
        df = df.withColumn("_l", (F.col("_l") + F.pmod(F.xxhash64(*seed, F.lit(2 * k), "_r"), wide)) % wide)
        df = df.withColumn("_r", (F.col("_r") + F.pmod(F.xxhash64(*seed, F.lit(2 * k + 1), "_l"), high)) % high)

    def step(value: Column) -> Column:
        left, right = F.floor(value / high).cast("long"), value % high
        for k in range(3):
            left = (left + F.pmod(F.xxhash64(*seed, F.lit(2 * k), right), wide)) % wide
            right = (right + F.pmod(F.xxhash64(*seed, F.lit(2 * k + 1), left), high)) % high
        return left * high + right

    df = df.withColumn("_once", F.col("_l") * high + F.col("_r"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.col("_once"), lambda at, _: F.when(at >= F.col(n), step(at)).otherwise(at))
    return df.withColumn(name, F.when(F.col("_once") < F.col(n), F.col("_once")).otherwise(walk)).drop("_wide", "_high", "_l", "_r", "_once")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document with its number of words, written out once: row, doc_id, source, size."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """A row for each source: key, place, source_size, target, blocks, slots, first_slot.

    Resharing the excess until no target is above its stop ends at one water level: target = min(stop, level * weight).
    Sources ordered by stop over weight are stopped up to a place; the level is what remains over the weights that remain.
    This table has one row per source, which is what the windows without a partition order.
    """
    by_point = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("place", F.row_number().over(by_point).cast("long") - 1).withColumn("weight", weight)
    out = out.withColumn("stop", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("stop") / F.col("weight"))
    out = out.select(
        "*",
        F.coalesce(F.sum("stop").over(before), F.lit(0.0)).alias("stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("used"),
        F.sum("weight").over(everything).alias("weights"),
        F.sum("source_size").over(everything).alias("total"),
    )
    level = (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("used"))
    # the level at the first place whose stop it doesn't reach; before that, the stops hold
    out = out.withColumn("level", level).withColumn("met", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    out = out.withColumn("level", F.first("met", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("target", F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))))
    out = out.withColumn("words", F.round("target").cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    rest = F.least(F.ceil(F.expr("words % greatest(source_size, 1)") / block).cast("long"), F.col("blocks"))
    out = out.withColumn("slots", F.expr("words div greatest(source_size, 1)") * F.col("blocks") + rest)
    return out.select(source_key().alias("key"), "place", "source_size", "target", "words", "slots", "blocks", F.sum("slots").over(everything).alias("all_slots"))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def before(sums: DataFrame, key: str, place: str, value: str, name: str, wide: int = WIDE) -> DataFrame:
    """sums (a row for each key and place) with the sum of the places before, in two levels, so a window holds `wide` places or one row for each so many."""
    earlier = lambda by, order, v: F.coalesce(F.sum(v).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = sums.withColumn("_group", F.expr(f"{place} div {wide}"))
    groups = grouped.groupBy(key, "_group").agg(F.sum(value).alias("_sum"))
    groups = groups.select(key, "_group", earlier([key], "_group", "_sum").alias("_start"))
    inside = grouped.withColumn("_inside", earlier([key, "_group"], place, value))
    return inside.join(groups, [key, "_group"]).withColumn(name, F.col("_inside") + F.col("_start")).drop("_group", "_inside", "_start")


def shard_counts(plan: DataFrame, seed: int = SEED, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The draw: how many blocks of each source each output shard holds (place, shard, n). A source's counts add up to its slots."""
    parts = plan.filter("slots > 0").withColumn("part", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK}L)")))
    lo = F.col("part") * CHUNK
    slots = parts.repartition(tasks_of(plan), "place", "part").withColumn("slot", F.explode(F.sequence(lo, F.least(lo + CHUNK, F.col("slots")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(seed), "place", "slot"), F.ceil(F.col("all_slots") / per_shard).cast("long"))
    return slots.groupBy("place", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def tasks_of(plan: DataFrame) -> int:
    """A plan of a few rows grows into all slots: the number of tasks must come from those, not from the plan's size."""
    return max(plan.sparkSession.sparkContext.defaultParallelism, -(-(plan.agg(F.max("all_slots")).first()[0] or 0) // SLOTS_PER_TASK))


def drawn(plan: DataFrame, block: int = BLOCK, seed: int = SEED, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """A row for each slot of the mix, shard by shard: place, shard, block, take (words), whole (all of the block)."""
    counts = written(shard_counts(plan, seed, per_shard), "draw")
    first = before(counts, "place", "shard", "n", "first").join(plan.select("place", "source_size", "words", "blocks"), "place")
    slots = first.repartition(tasks_of(plan), "place", "shard").withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    last = F.col("blocks") - 1
    slots = slots.withColumns({"turn": F.expr("slot div blocks"), "at": F.expr("slot % blocks"), "others": F.greatest(last, F.lit(1))})
    slots = permuted(slots, "other", "at", "others", F.lit(seed), F.col("place"), F.col("turn"))
    picked = F.when(F.col("at") == last, last).otherwise(F.col("other"))
    length = F.when(F.col("at") == last, F.col("source_size") - last * block).otherwise(F.lit(block).cast("long"))
    left = F.col("words") - F.col("turn") * F.col("source_size") - F.col("at") * block
    return slots.select("place", "shard", picked.alias("block"), F.least(length, left).alias("take"), (left >= length).alias("whole"))


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the start of their words in their source's stream.

    Prefix sums in levels: over buckets of a source, then inside a bucket, so no window holds a source. Sizes count in the
    bucket, so rows whose doc_id is null are spread too.
    """
    buckets = max(1, -(-sizes.count() // ROWS_PER_BUCKET))
    rows = sizes.select("*", source_key().alias("key"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket"))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words_in"))
    offsets = before(sums, "key", "bucket", "words_in", "offset").select("key", "bucket", "offset").join(plan, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("inside", start).join(offsets, ["key", "bucket"]).withColumn("start", F.col("inside") + F.col("offset")).drop("inside", "offset")


def met(places: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block of it: row, block, begin and end (in the block), full (takes of all), part (words of a last, partial take), the first and last shard that take it."""
    # merge: what is made from the few rows of the plan looks small to the optimiser, and isn't
    used = slots.groupBy("place", "block").agg(
        F.sum(F.col("whole").cast("long")).alias("full"),
        F.max(F.when(~F.col("whole"), F.col("take")).otherwise(0)).alias("part"),
        F.min("shard").alias("first_shard"),
        F.max("shard").alias("last_shard"),
    )
    spans = places.filter("size > 0").select("row", "place", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return spans.select("row", "place", "block", begin.alias("begin"), end.alias("end")).join(used.hint("merge"), ["place", "block"])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words that the mix takes of it, repeats counted), and the first and last output shard that hold some of it."""
    sizes = sized(docs)
    plan = written(targets(sizes, weights, cap, block), "targets")
    places = written(placed(sizes, plan).select("row", "doc_id", "size", "source_size", "target", "place", "start"), "places")
    each = met(places, drawn(plan, block, seed, per_shard), block)
    words = F.col("full") * (F.col("end") - F.col("begin")) + F.greatest(F.least("end", "part") - F.col("begin"), F.lit(0))
    each = each.withColumn("words", words).filter("words > 0")
    taken = each.groupBy("row").agg(F.sum("words").alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    joined = places.join(taken.hint("merge"), "row", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of docs: pass k has each document's words in blocks that the mix takes k times or more.

    A document taken whole in a pass keeps its text as it is; of another its words in the blocks taken, with the white space before each.
    """
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), count.alias("size"), F.struct("*").alias("doc")), "mixed")
    sizes = rows.select("row", "size", "doc.doc_id", "doc.source")
    plan = written(targets(sizes, weights, cap, block), "targets")
    places = written(placed(sizes, plan).select("row", "size", "place", "start"), "places")
    each = met(places, drawn(plan, block, seed), block)
    spans = each.groupBy("row").agg(F.collect_list(F.struct("block", "begin", "end", "full", "part")).alias("spans"))
    spans = spans.select("row", F.array_sort("spans").alias("spans"), F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("pass"))
    # words kept of a span in this pass: all, or those before the end of a partial take
    kept = lambda s: F.when(s["full"] >= F.col("pass"), s["end"]).when(s["full"] + 1 == F.col("pass"), F.least(s["end"], s["part"])).otherwise(F.lit(0))
    spans = spans.withColumn("kept", F.transform("spans", lambda s: F.struct(s["block"].alias("block"), s["begin"].alias("begin"), kept(s).cast("long").alias("until"))))
    spans = spans.withColumn("words", F.aggregate("kept", F.lit(0).cast("long"), lambda n, s: n + F.greatest(s["until"] - s["begin"], F.lit(0).cast("long"))))
    spans = spans.filter("words > 0").select("row", "words", F.map_from_entries(F.transform("kept", lambda s: F.struct(s["block"], s["until"]))).alias("until"))
    taken = F.expr(
        f"array_join(filter(regexp_extract_all(doc.text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), "
        f"(w, i) -> (lead + i) % {block} < coalesce(try_element_at(until, base + (lead + i) div {block}), 0L)), '')"
    )
    starts = places.select("row", (F.col("start") % block).alias("lead"), F.expr(f"start div {block}").alias("base"))
    joined = rows.join(spans.join(starts.hint("merge"), "row").hint("merge"), "row")
    text = F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(taken)
    out = joined.select(F.col("doc").withField("text", text).alias("doc"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("doc").withField("n_chars", F.length("doc.text").cast(dict(docs.dtypes)["n_chars"])).alias("doc"))
    return out.select("doc.*")
