"""Mixing sources to target weights: fixed-length blocks, drawn per output shard, joined by index.

1. Documents of a source, in seeded order, are laid end to end and cut into blocks of `block_words` words.
2. A source's share of the mix becomes a number of block slots. The slots of all sources are dealt to the places of the
   output by one pseudorandom permutation of all slots, so every output shard holds a random draw of sources: its counts
   are multinomial, given that the totals over all shards are the targets. (Independent draws would miss the targets by
   their own noise and could pass a source's cap.)
3. Slot i of a source takes block perm(i mod blocks) of a pseudorandom permutation of that source's blocks, so no block is
   taken again before all others were.
4. Slots and pieces of documents meet in a join on (source, block).

Permutations are computed per index (swap-or-not rounds), so nothing is sorted or kept, and a lost task redraws the same
numbers. DataFrame operations only.

Edge cases. Null text or no word: size 0, nothing is taken. Null source: a source of its own, last in order. Null or
repeated doc_id: rows stay apart. Empty table: empty result. A very long document is cut into size / block_words pieces.
Other columns are not read unless asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.strata import cell_count, in_cells, stratum_key
from cohortlens.llm.text import word_count, word_stretches
from cohortlens.session import settle

_CHUNK = 4096


def permuted(x: Column, n: Column, seed: Column, rounds: int = 16, back: bool = False) -> Column:
    """Place of index x in a pseudorandom permutation of 0..n-1; `back` gives the inverse.

    Each round pairs x with (k - x) mod n and swaps the two if a hash bit of the pair says so; a round undoes itself.
    """
    steps = range(rounds)[::-1] if back else range(rounds)

    def swap(a: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(seed, r) % n - a, n)
        return F.when(F.xxhash64(seed, r, F.greatest(a, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(a)

    return F.aggregate(F.array(*[F.lit(r) for r in steps]), x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: __stratum, source, source_size. Adds target: `total` times all sizes shared by weight, no source above `cap`
    times its size, the excess going to the others by weight.

    Sharing again and again until no source is above its cap ends at min(cap * size, level * weight) with one level for
    all; sources reach their cap in the order of cap * size / weight, so the level follows from running sums. One row per
    source goes through the unpartitioned windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    weighted = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn(
        "__cap", F.lit(float(cap)) * F.col("source_size")).withColumn(
        "__goal", F.lit(float(total)) * F.sum("source_size").over(everyone)).withColumn("__fill", F.col("__cap") / F.col("weight"))
    rising = Window.orderBy("__fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.sum("weight").over(everyone) - F.sum("weight").over(rising)
    capped = weighted.withColumn("__full", F.sum("__cap").over(rising) + F.col("__fill") * rest <= F.col("__goal"))
    left = F.col("__goal") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)).over(everyone)
    open_weight = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("weight"))).over(everyone)
    return capped.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(
        F.least(F.col("__cap"), left * F.col("weight") / open_weight))).drop("__cap", "__goal", "__fill", "__full")


def block_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: __stratum, block, epoch, output_shard, output_slot."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # a source's last block may be short, so slots follow from its mean block; at the cap every block goes `cap` times
    plan = targets.where("source_size > 0").withColumn("__blocks", blocks).withColumn(
        "__slots", F.round(F.col("target") * F.col("__blocks") / F.col("source_size")).cast("long"))
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("__first", F.coalesce(F.sum("__slots").over(upto), F.lit(0))).withColumn(
        "__all", F.sum("__slots").over(every)).where("__slots > 0")
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    parts = 1 + int(words / block_words / 50_000)  # a fixed number: rows are made after this shuffle, so it looks small to AQE
    chunks = plan.select("__stratum", "__blocks", "__slots", "__first", "__all", F.explode(
        F.expr(f"sequence(0L, (__slots - 1) div {_CHUNK})")).alias("__chunk")).repartition(parts, "__stratum", "__chunk")
    slots = chunks.select("*", F.explode(F.expr(
        f"sequence(__chunk * {_CHUNK}, least((__chunk + 1) * {_CHUNK}, __slots) - 1)")).alias("__i"))
    at = permuted(F.col("__first") + F.col("__i"), F.col("__all"), F.lit(seed), back=True)
    return slots.select(
        "__stratum", permuted(F.col("__i") % F.col("__blocks"), F.col("__blocks"), F.xxhash64(F.lit(seed + 1), "__stratum")).alias("block"),
        F.expr("__i div __blocks").alias("epoch"), at.alias("__at")).select(
        "__stratum", "block", "epoch", F.expr(f"__at div {shard_slots}").alias("output_shard"),
        F.expr(f"__at % {shard_slots}").alias("output_slot"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, block_words: int = 64,
        shard_slots: int = 16384, seed: int = 11, with_text: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(pieces, taken).

    pieces: one row per stretch of a document that lies in one block: __row (of the document), doc_id, source, size,
    source_size, target, block, from_word, words, `keep`, and with_text the stretch itself, cut out of the text as it is: the
    stretches of a document in order are the document.
    taken: the pieces in the mix, once per slot, with epoch, output_shard and output_slot; pieces of no slot, and
    documents without words, have nulls there.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", stratum_key(F.col("source")).alias("__stratum"), F.lit(seed).alias("__seed"),
        word_count(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("__crc"),
        F.struct(*keep).alias("__keep") if keep else F.lit(0).alias("__keep"), *([F.col("text").alias("__text")] if with_text else []))
    read = read if with_text else settle(read)  # texts are scanned once, what is left is narrow
    totals = read.groupBy("__stratum", "source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(totals, weights, total, cap))
    cells = cell_count(docs.count())
    laid = in_cells(read, "__stratum", ["__seed", "doc_id", "__crc", "size"], "size", cells, ["doc_id", "__crc", "size"],
                    targets.select("__stratum", "source_size", "target"))
    cut = F.expr(f"CASE WHEN size > 0 THEN sequence(__before div {block_words}, (__before + size - 1) div {block_words}) END")
    start = F.greatest(F.col("__before"), F.col("block") * block_words)
    end = F.least(F.col("__before") + F.col("size"), (F.col("block") + 1) * block_words)
    if with_text:  # split once per document, before its rows are made
        laid = laid.withColumn("__words", word_stretches(F.col("__text"))).drop("__text")
    pieces = laid.withColumn("block", F.explode_outer(cut)).withColumn("from_word", start - F.col("__before")).withColumn(
        "words", F.coalesce(end - start, F.lit(0))).withColumn("__row", F.struct("__cell", "__rank"))
    out = ["__stratum", "__row", "doc_id", "source", "size", "source_size", "target", "block", "from_word", "words"]
    text = [F.array_join(F.slice("__words", (F.col("from_word") + 1).cast("int"), F.col("words").cast("int")), "").alias(
        "text")] if with_text else []
    pieces = pieces.select(*out, *text, *[F.col("__keep")[c].alias(c) for c in keep])
    slots = block_slots(targets, block_words, shard_slots, seed)
    # planned sizes know nothing of the rows that are made after the last shuffle: never broadcast them
    return pieces, pieces.join(slots.hint("merge"), ["__stratum", "block"], "left")
