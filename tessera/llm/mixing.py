"""Mixing sources to target weights, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Workspace, free_name

#: Tables of sources or pieces of them are broadcast up to so many rows.
BROADCAST_ROWS = 100_000
#: Running sums go through bands of so many rows, so that no task holds all rows of a source.
BAND = 4096
#: Steps of a cycle walk. A step leaves the range with chance 1 / sqrt(n) at most, and for n up to BAND never so often in a row.
WALK = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 for each key: a Feistel network on pairs (left, right) below a and b, a * b hardly larger than n, and a
    walk along its cycle for what falls beyond n."""
    a = F.ceil(F.sqrt(n)).cast("bigint")
    b = F.ceil(n / a).cast("bigint")

    def shuffled(x: Column) -> Column:
        left, right = F.floor(x / b).cast("bigint"), F.pmod(x, b)
        for r in range(3):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(2 * r), *key), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(2 * r + 1), *key), b), b)
        return left * b + right

    first = shuffled(F.pmod(i, n))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(shuffled(x)))
    return F.when(first < n, first).otherwise(walked)


def running(rows: DataFrame, by: list[str], at: str, amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows before each in order of ``at``, an integer that is unique within ``by``. Sums of bands are added up first, so that
    neither a window over a band nor that over the bands of one group gets many rows."""
    banded = rows.withColumn("_band", F.floor(F.col(at) / BAND).cast("bigint"))
    bands = banded.groupBy(*by, "_band").agg(F.sum(amount).alias("_sum"))
    up_to = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    bands = bands.withColumn("_before", F.sum("_sum").over(up_to(by or [F.lit(0)], "_band")) - F.col("_sum")).drop("_sum")
    inside = banded.withColumn("_inside", F.sum(amount).over(up_to([*by, "_band"], at)) - F.col(amount))
    return inside.join(bands, [*by, "_band"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_band", "_before", "_inside")


def within(values: DataFrame, value: str, ranges: DataFrame, total: int) -> DataFrame:
    """Joins rows whose ``value``, from 0 to total - 1, lies in [_from, _to) of ranges that cover it without overlap. Ranges are cut at multiples of a step; the pieces, few
    more than there are steps and ranges, meet values by equality."""
    step = max(1, total // BAND)
    pieces = ranges.where("_to > _from").withColumn("_piece", F.explode(F.expr(f"sequence(_from div {step}, (_to - 1) div {step})")))
    pieces = F.broadcast(pieces) if pieces.count() < BROADCAST_ROWS else pieces
    return values.withColumn("_piece", F.expr(f"`{value}` div {step}")).join(pieces, "_piece").where(f"`{value}` >= _from AND `{value}` < _to").drop("_piece", "_from", "_to")


def source_targets(work: Workspace, sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """From rows (source, size) one row per source: _s (place by code point, null last), source, source_size, target.

    The targets share the sum of all sizes by weight, the weights repeating in order of place. A target above ``most`` times the
    size of its source stops there, and the excess goes to the others by weight, until none is above: each step is a sum over the sources, of which the driver sees
    three numbers. Places come from a sort by ranges and the numbers of rows of the ranges before.
    """
    order = F.col("source").asc_nulls_last()
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = work.save(sources.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "by_place")
    ahead = sources.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    ahead = ahead.withColumn("_ahead", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).drop("_n")
    sources = sources.withColumn("_nth", F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1).join(ahead, "_p")
    sources = sources.withColumn("_s", (F.col("_ahead") + F.col("_nth")).cast("bigint"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_s") % len(weights) + 1).cast("int"))
    sources = work.save(sources.select("_s", "source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap")), "weighted")
    level = None
    while True:
        capped = F.col("_cap") < F.col("_w") * F.lit(level) if level is not None else F.lit(False)
        size, given, left = sources.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("_w")))).first()
        new = (float(size or 0) - (given or 0.0)) / left if left else level or 0.0
        if level is not None and new <= level * (1 + 1e-15):
            break
        level = new
    return sources.select("_s", "source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def drawn_slots(work: Workspace, sources: DataFrame, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """Slots _shard, _place, _s and _nth, the number of the slot among those of its source; of each source exactly as many as its _slots.

    Every slot draws its source by itself, with chance in proportion to _slots, so that the counts of a shard are multinomial. Over all shards a
    source then has some slots too many or too few, in the order of the square root of their number; those too many go to the sources with too few.
    """
    spark = work.spark
    slots = spark.range(total).select(F.floor(F.col("id") / shard_blocks).cast("bigint").alias("_shard"), (F.col("id") % shard_blocks).alias("_place"))
    slots = slots.withColumn("_g", F.pmod(F.xxhash64("_shard", "_place", F.lit(seed)), F.lit(total)))
    slots = within(slots, "_g", sources.select("_s", "_from", "_to"), total).drop("_g")
    slots = work.save(slots.withColumn("_in", F.row_number().over(W.partitionBy("_shard", "_s").orderBy("_place")) - 1), "drawn")
    counts = running(slots.groupBy("_s", "_shard").agg(F.count(F.lit(1)).alias("_n")), ["_s"], "_shard", "_n", "_ahead")
    slots = slots.join(counts.drop("_n"), ["_s", "_shard"]).withColumn("_nth", F.col("_ahead") + F.col("_in")).drop("_ahead", "_in")
    slots = work.save(slots, "numbered")
    have = sources.select("_s", "_slots").join(slots.groupBy("_s").agg(F.count(F.lit(1)).alias("_have")), "_s", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    have = have.withColumn("_over", F.greatest(F.col("_have") - F.col("_slots"), F.lit(0))).withColumn("_under", F.greatest(F.col("_slots") - F.col("_have"), F.lit(0)))
    have = running(running(have, [], "_s", "_over", "_over_from"), [], "_s", "_under", "_from")
    have = work.save(have.withColumn("_to", F.col("_from") + F.col("_under")), "have")
    moved = have.agg(F.sum("_over")).first()[0] or 0
    facts = have.select("_s", "_slots", "_have", "_over_from")
    slots = slots.join(F.broadcast(facts) if facts.count() < BROADCAST_ROWS else facts, "_s")
    slots = slots.withColumn("_nth", permuted(F.col("_nth"), F.col("_have"), F.lit(seed), F.col("_s"), F.lit("over")))  # those too many come from all shards alike
    stay = slots.where("_nth < _slots").select("_shard", "_place", "_s", "_nth")
    if not moved:
        return stay
    over = slots.where("_nth >= _slots").select("_shard", "_place", (F.col("_over_from") + F.col("_nth") - F.col("_slots")).alias("_q"))
    to = have.select("_s", "_have", "_from", "_to", F.col("_from").alias("_begin"))
    return stay.unionByName(within(over, "_q", to, moved).select("_shard", "_place", "_s", (F.col("_have") + F.col("_q") - F.col("_begin")).alias("_nth")))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block_words: int = 32, shard_blocks: int = 1024, chunk_docs: int = 1000, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix sources to their targets (see source_targets). Returns (slots, pieces, taken).

    * The words of a source, its documents one after another in a fixed order, form blocks of a fixed length: ``block_words``, less for a
      small source, so that it has 256 blocks or one a word. Its last block may be shorter.
    * A source gets target / size * blocks slots, rounded. All slots form output shards of ``shard_blocks``, whose source counts are drawn
      from a multinomial law (see drawn_slots).
    * The slots of a source run through its block indices, in a new pseudorandom permutation for each pass, so that no block is used
      k + 1 times before all are used k times. Therefore no document exceeds ``most`` times its size.
    * Blocks join slots by source and index (see mixed_blocks).

    slots: _shard, _place, _s (place of the source), _block (index). pieces: what each document has of each block: _row, _s, _block, _at (place in the source), _skip (words of the
    document before) and _words. taken: one row per document with its id, size, source_size, target, taken (the words the mix takes of it, repeats counted), _row (the value of ``row_col``, or a
    number of its own) and _first (its place in its source). The draw depends on ids, sizes and ``seed`` only, so that reruns agree.

    Null texts and texts without words have size 0 and are taken 0 times; a source of such documents has target 0. Null is a source, last
    in order. Rows that repeat an id, or have none, count each; their order follows the size, and ties are the same for every use. An empty table
    gives empty results. Other columns are ignored.
    """
    work = Workspace(spark, "mix")
    row = docs[row_col] if row_col else F.monotonically_increasing_id()
    sized = work.save(docs.select(row.alias("_row"), docs[id_col].alias("_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size")), "sized")
    n_docs = sized.count()
    sources = source_targets(work, sized.select("source", "size"), weights, most)
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / 256))).cast("bigint")
    sources = sources.withColumn("_len", length).withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_len")).cast("bigint"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_slots", F.least(F.round(ratio * F.col("_blocks")), F.col("_blocks") * most).cast("bigint"))
    sources = work.save(running(sources, [], "_s", "_slots", "_from").withColumn("_to", F.col("_from") + F.col("_slots")), "sources")
    n_sources = sources.count()
    small = lambda df: F.broadcast(df) if n_sources < BROADCAST_ROWS else df
    total = sources.agg(F.max("_to")).first()[0] or 0

    slots = drawn_slots(work, sources, total, shard_blocks, seed) if total else spark.createDataFrame([], "_shard long, _place long, _s long, _nth long")
    slots = slots.join(small(sources.select("_s", "_blocks")), "_s")
    index = permuted(F.col("_nth"), F.col("_blocks"), F.lit(seed), F.col("_s"), F.floor(F.col("_nth") / F.col("_blocks")))
    slots = work.save(slots.select("_shard", "_place", "_s", index.alias("_block")), "slots")

    # Where a document's words lie in its source: chunks of documents by hash of the id, so that a hot source spreads over many tasks.
    facts = sources.select(F.col("source").alias("_source"), "_s", "source_size", "target", "_len")
    placed = sized.join(small(facts), sized["source"].eqNullSafe(facts["_source"])).drop("_source", "source")
    placed = placed.withColumn("_chunk", F.pmod(F.xxhash64("_id", "size", F.lit(seed)), F.lit(max(1, n_docs // chunk_docs))))
    in_chunk = W.partitionBy("_s", "_chunk").orderBy("_id", "size", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = running(placed.groupBy("_s", "_chunk").agg(F.sum("size").alias("_sum")), ["_s"], "_chunk", "_sum", "_start").drop("_sum")
    placed = placed.withColumn("_run", F.sum("size").over(in_chunk) - F.col("size")).join(starts, ["_s", "_chunk"])
    placed = work.save(placed.withColumn("_first", F.col("_start") + F.col("_run")).drop("_start", "_run", "_chunk"), "placed")

    pieces = placed.where("size > 0").select("_row", "_s", "size", "_len", "_first", F.explode(F.expr("sequence(_first div _len, (_first + size - 1) div _len)")).alias("_block"))
    begin = F.greatest(F.col("_first"), F.col("_block") * F.col("_len"))
    end = F.least(F.col("_first") + F.col("size"), (F.col("_block") + 1) * F.col("_len"))
    pieces = pieces.select("_row", "_s", "_block", begin.alias("_at"), (begin - F.col("_first")).alias("_skip"), (end - begin).alias("_words"))
    used = slots.groupBy("_s", "_block").agg(F.count(F.lit(1)).alias("_times"))
    words = pieces.join(used, ["_s", "_block"]).groupBy("_row").agg(F.sum(F.col("_words") * F.col("_times")).alias("_taken"))
    taken = placed.join(words, "_row", "left").select(
        F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"), "_row", "_first"
    )
    return slots, pieces, taken


def mixed_blocks(spark: SparkSession, docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: _shard, _place, _s and text, the words of the block in that slot joined by one space. Blocks are cut from the documents once and join the slots by index."""
    work, row = Workspace(spark, "blocks"), free_name("_mix_row", docs)
    rows = work.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    slots, pieces, _ = mix(spark, rows, text_col=text_col, row_col=row, **options)
    texts = rows.select(F.col(row).alias("_row"), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("_all"))
    cut = F.array_join(F.slice("_all", (F.col("_skip") + 1).cast("int"), F.col("_words").cast("int")), " ")
    parts = pieces.join(texts, "_row").select("_s", "_block", "_at", cut.alias("_t"))
    blocks = parts.groupBy("_s", "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "_t"))).alias("_parts"))
    blocks = blocks.select("_s", "_block", F.array_join(F.transform("_parts", lambda p: p["_t"]), " ").alias("text"))
    return slots.join(blocks, ["_s", "_block"]).select("_shard", "_place", "_s", "text")


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """The mix in whole documents: each with all its columns, as many times as the mix takes its words, taken / size. The fraction is
    rounded up or down by a hash of the id and its place in its source, up as often as it says, so that sources keep their share. Every row counts by itself, also
    of null and repeated ids. Documents without words go."""
    row, times, copy = (free_name(c, docs) for c in ("_mix_row", "_copies", "_copy"))
    rows = Workspace(spark, "mixed").save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix(spark, rows, id_col=id_col, seed=seed, row_col=row, **options)[2]
    share = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64(id_col, "_first", F.lit(seed), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(share) + (chance < share - F.floor(share)).cast("bigint")
    counts = taken.where("size > 0").select(F.col("_row").alias(row), copies.cast("int").alias(times)).where(F.col(times) > 0)
    found = rows.join(counts, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
