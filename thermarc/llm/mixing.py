"""Mixing sources to target weights, in blocks of a fixed number of words.

The documents of a source, in a pseudorandom order, are one stream of words, cut into blocks of `block` words (the last one may be
shorter). A source's target is its share of all words by weight, at most `most` times its own words; what is above goes to the others by weight.
The output is shards of `shard_blocks` slots. Each shard draws a multinomial count of slots for each source. A source's slots, numbered
through all shards, take its blocks in the order of a pseudorandom permutation, a new one each time all blocks are used up, and slots
and blocks are joined by index. Slots that were drawn beyond a source's target go to the sources that were drawn short of theirs, and a source's last slot
takes only the words that the target still lacks, so each source gives exactly its target, rounded down, and no document more than `most` times its words.

All of it is integer arithmetic, joins and sums: reruns agree, and SQL can state it.

Defined results: a null text has size 0, documents without words are taken 0 times and have no shard. Null sources are one source, the last. Null
ids are placed like an id of their own. Equal rows are taken one by one, and may swap places. Without any words targets are 0. An empty table gives an empty result. Texts
are taken whole, whatever their length. Other columns are not kept.

The table of sources is one row a source, in one task when it is ranked. It is broadcast by Spark where its stored size allows that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.llm.ordering import running
from thermarc.llm.text import whole_text, words

BLOCK = 256
SHARD_BLOCKS = 1024
WEIGHTS = (5, 2, 1)
MOST = 3
ROUNDS = 16
#: Cells that a table of ranges is cut into: a value looks only at the ranges of its cell.
CELLS = 4096
#: Shards that are summed up together first.
SHARD_GROUP = 1024
#: The modulus of `scramble`, and multipliers: products of two numbers below PRIME fit 62 bits, those of a place below 2**40 and SPREAD fit 63.
PRIME = 2**31 - 1
SPREAD, STEP = 4194301, 1343714438


def scramble(x: Column, key: Column) -> Column:
    """A pseudorandom number below PRIME: a linear step and a square modulo a prime. x below 2**40, key below PRIME."""
    a = (x * SPREAD + key) % PRIME
    return (a * a + key) % PRIME


def wide(x: Column, key: int, below: Column) -> Column:
    """A pseudorandom number from 0 to below - 1, out of 61 bits."""
    first, second = scramble(scramble(x, F.lit(key)), F.lit(key + 1)), scramble(scramble(x, F.lit(key + 2)), F.lit(key + 3))
    return (first * F.lit(2**30) + second % F.lit(2**30)) % below


def permuted(x: Column, n: Column, keys: Column, turn: Column) -> Column:
    """The place of x, below n, in a pseudorandom permutation of n: swap or not, once a round, with the partner at the round's key minus x. It
    is a bijection for any n, as both partners look at the same bit. keys: one number a round; turn: another permutation for each."""

    def swapped(x: Column, k: Column) -> Column:
        partner = F.pmod(k + turn * STEP - x, n)
        return F.when(F.floor(scramble(F.greatest(x, partner), F.pmod(k + turn, F.lit(PRIME))) / 128) % 2 == 1, partner).otherwise(x)

    return F.when(n < 2, x).otherwise(F.aggregate(keys, x, swapped))


def round_keys(seed: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), lambda r: wide(seed * ROUNDS + r, 11, F.greatest(n, F.lit(1))))


def sources(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """source, source_no, source_size, weight, target, and what its slots need, for rows of `sized`. One row a source.

    Targets: the level is the number for which min(most * size, level * weight) sums up to all words. In the order of most * size / weight the
    sources at their bound come first, so the first source whose level leaves it below its bound has the level of all."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1).withColumn("weight", weight)
    room, everything = most * F.col("source_size"), Window.partitionBy()
    order = Window.orderBy(room / F.col("weight"), "source_no")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_place", F.row_number().over(order))
    per = per.withColumn("_level", (F.col("_total") - F.coalesce(F.sum(room).over(before), F.lit(0))) / F.sum("weight").over(after))
    fits = F.when(F.col("_level") * F.col("weight") <= room, F.struct("_place", "_level"))
    per = per.withColumn("_level", F.min(fits).over(everything)["_level"])
    per = per.withColumn("target", F.least(room.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), room.cast("double"))))
    size = F.greatest("source_size", F.lit(1))
    whole = F.floor("target")
    per = per.withColumns({"full_blocks": F.floor(F.col("source_size") / block), "tail": F.col("source_size") % block, "turns": F.floor(whole / size), "rest": whole % size})
    per = per.withColumns({"blocks": F.col("full_blocks") + F.signum("tail").cast("long"), "rest_slots": F.ceil(F.col("rest") / block)})
    per = per.withColumn("slots", F.col("turns") * F.col("blocks") + F.col("rest_slots")).withColumn("keys", round_keys(F.col("source_no"), F.col("full_blocks")))
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("first", F.coalesce(F.sum("slots").over(ahead), F.lit(0)))
    return per.drop("_total", "_place", "_level")


def _in_ranges(rows: DataFrame, value: str, ranges: DataFrame, total: int) -> DataFrame:
    """Joins each row with the range [first, first + slots) that holds its value, by cells of equal width. Values are below total."""
    width = max(1, -(-total // CELLS))
    cells = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width))
    ranges = ranges.where("slots > 0").withColumn("_cell", F.explode(cells))
    rows = rows.withColumn("_cell", F.floor(F.col(value) / width))
    return rows.join(ranges, "_cell").where((F.col(value) >= F.col("first")) & (F.col(value) < F.col("first") + F.col("slots"))).drop("_cell", "first", "slots")


def _whole_number(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def slots(spark: SparkSession, per: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """shard, position (in the shard), source_no, block, n_words: what each slot of the output takes. per: the stored table of `sources`."""
    n = _whole_number(per, "slots")
    drawn = spark.range(n).select(F.floor(F.col("id") / shard_blocks).alias("shard"), wide(F.col("id"), 5, F.lit(max(n, 1))).alias("_draw"))
    drawn = _in_ranges(drawn, "_draw", per.select("source_no", "first", "slots"), n)
    counts = stored(drawn.groupBy("shard", "source_no").agg(F.count("*").alias("n_drawn")), "shard-counts")

    counts = counts.withColumn("_group", F.floor(F.col("shard") / SHARD_GROUP))
    within = Window.partitionBy("source_no", "_group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_no").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("source_no", "_group").agg(F.sum("n_drawn").alias("_n")).select("source_no", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = counts.withColumns({"_own": F.coalesce(F.sum("n_drawn").over(within), F.lit(0)), "_place": F.coalesce(F.sum("n_drawn").over(in_shard), F.lit(0))})
    here = F.least(F.lit(n) - F.col("shard") * shard_blocks, F.lit(shard_blocks))
    counts = counts.join(groups, ["source_no", "_group"]).withColumn("_here", here).withColumn("_shard_keys", round_keys(F.col("shard") + 1_000_003, F.col("_here")))
    taken = F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("n_drawn"))).alias("_k", "_one")
    out = counts.select("shard", "source_no", (F.col("_own") + F.col("_before")).alias("_first"), "_place", "_here", "_shard_keys", taken)
    position = permuted((F.col("_place") + F.col("_k")), F.col("_here"), F.col("_shard_keys"), F.lit(0))
    out = out.select("shard", "source_no", (F.col("_first") + F.col("_k")).alias("_index"), position.alias("position"))

    # drawn beyond a source's slots: to the sources that were drawn short of theirs, in order
    sums = per.select("source_no", "slots").join(counts.groupBy("source_no").agg(F.sum("n_drawn").alias("_n")), "source_no", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    over, short = F.greatest(F.col("_n") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("_n"), F.lit(0))
    sums = stored(sums.select("source_no", F.col("slots").alias("_slots"), "_n", over.alias("over"), F.coalesce(F.sum(over).over(ahead), F.lit(0)).alias("over_first"), short.alias("slots"), F.coalesce(F.sum(short).over(ahead), F.lit(0)).alias("first")), "surplus")
    out = out.join(sums.select("source_no", "_slots", "over_first"), "source_no")
    kept = out.where("_index < _slots").select("shard", "position", "source_no", "_index")
    moved = out.where("_index >= _slots").select("shard", "position", (F.col("over_first") + F.col("_index") - F.col("_slots")).alias("_value"))
    short_of = sums.select("source_no", "first", "slots", F.col("first").alias("_from"), F.col("_n").alias("_has"))
    moved = _in_ranges(moved, "_value", short_of, _whole_number(sums, "slots")).select("shard", "position", "source_no", (F.col("_has") + F.col("_value") - F.col("_from")).alias("_index"))

    out = kept.unionByName(moved).join(per.select("source_no", "full_blocks", "blocks", "tail", "turns", "rest", "rest_slots", "keys"), "source_no")
    out = out.withColumns({"_turn": F.floor(F.col("_index") / F.col("blocks")), "_at": F.col("_index") % F.col("blocks")})
    out = out.withColumn("block", F.when(F.col("_at") == F.col("full_blocks"), F.col("_at")).otherwise(permuted(F.col("_at"), F.col("full_blocks"), F.col("keys"), F.col("_turn"))))
    length = F.when(F.col("block") == F.col("full_blocks"), F.col("tail")).otherwise(F.lit(block).cast("long"))
    last = (F.col("_turn") == F.col("turns")) & (F.col("_at") == F.col("rest_slots") - 1)
    return out.select("shard", "position", "source_no", "block", F.when(last, F.col("rest") - F.col("_at") * block).otherwise(length).alias("n_words"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source, size (words) and what places the document in its source's stream: a digest of id and size, then the text's checksum. carry: the text too."""
    t = whole_text(text)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(t)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("_crc"), *([t.alias("text")] if carry else []))
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))
    return rows.withColumn("_mark", F.md5(mark.cast("binary")))


def laid_out(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows of `sized` with source_no, source_size, target and `start`, the words of the source before the document's first."""
    per = per.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    return running(rows, ["source_no"], [F.col("_mark"), F.col("_crc")], start=F.col("size")).drop("_mark", "_crc")


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The blocks that each document has words in: block, and from, to within the block."""
    end = F.col("start") + F.col("size")
    out = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    return out.withColumns({"_from": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), "_to": F.least(end - F.col("block") * block, F.lit(block))})


def usage(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, and the first shard that has words of it."""
    rows = stored(sized(docs, key, text, source), "sizes")
    per = stored(sources(rows, weights, most, block), "sources")
    rows = stored(laid_out(rows, per), "documents-laid-out")
    cut = F.when(F.col("block") < F.col("full_blocks"), F.lit(block)).otherwise(F.col("tail")) > F.col("n_words")
    used = slots(docs.sparkSession, per, block, shard_blocks).join(per.select("source_no", "full_blocks", "tail"), "source_no")
    used = used.groupBy("source_no", "block").agg(F.sum(F.when(cut, 0).otherwise(1)).alias("_times"), F.max(F.when(cut, F.col("n_words")).otherwise(0)).alias("_cut"), F.min("shard").alias("first_shard"), F.min(F.when(~cut, F.col("shard"))).alias("_first_whole"))
    pieces = _pieces(rows, block).join(used, ["source_no", "block"], "left")
    in_cut = F.greatest(F.least("_to", "_cut") - F.col("_from"), F.lit(0))
    taken = F.col("_times") * (F.col("_to") - F.col("_from")) + in_cut
    shard = F.when(in_cut > 0, F.col("first_shard")).otherwise(F.col("_first_whole"))
    got = pieces.groupBy(*rows.columns).agg(F.coalesce(F.sum(taken), F.lit(0)).alias("taken"), F.min(shard).alias("first_shard"))
    none = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
    return got.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mixed corpus: shard, position, source, block, words (an array of `block` words; fewer in a source's last block and last slot)."""
    per = stored(sources(sized(docs, key, text, source), weights, most, block), "sources")
    pieces = _pieces(laid_out(sized(docs, key, text, source, carry=True), per), block)
    at = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    part = F.struct("_from", F.slice(words(F.col("text")), (at + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")).alias("_words"))
    packed = pieces.select("source_no", "block", part.alias("_part")).groupBy("source_no", "block").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    packed = packed.select("source_no", "block", F.flatten(F.col("_parts._words")).alias("words"))
    out = slots(docs.sparkSession, per, block, shard_blocks).join(packed, ["source_no", "block"]).join(per.select("source_no", "source"), "source_no")
    return out.select("shard", "position", "source", "block", F.slice("words", F.lit(1), F.col("n_words").cast("int")).alias("words"))
