"""Mixing sources to target weights by systematic sampling.

Sizes count words. Sources, in code point order with null last, weigh 1, 2, 3 and
again 1, 2, 3; all sizes together are shared out by weight, but no source gets
more than ``MOST`` times its own size; the excess is shared by weight among the
others until no source is above. That is one level per unit of weight, found from
the sources' running sums in the order of cap per weight.

Within a source every document expects the same number of copies. Documents are
put in order of size and id, the expected copies are summed along that order, one
offset drawn from a digest of the seed and the source is added, and a document is
emitted once for each integer its sum crosses. In order of size, the words taken
miss the target by about the longest document at most.

Defined results: null text has size 0; documents without words are taken 0 times;
rows that repeat id, source and size stand side by side in the order and are drawn
one by one, so which of them is taken how often is decided by a digest of the text;
an empty table gives an empty table; the operator's own columns ``_mix_*`` aside,
every column is kept whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.operators.ordered import before, number, ordered_scan
from stratalog.session import settle_table

MOST = 3
WEIGHTS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: source, source_size, target. Windows run over sources, not documents."""
    totals = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    weighed = totals.withColumn("_w", (F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1) % WEIGHTS + 1)
    cap = (F.col("source_size") * MOST).alias("_cap")
    ratio = F.col("_cap").cast("double") / F.col("_w")
    order = W.orderBy("_ratio", F.col(source).asc_nulls_last())
    before, onward, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_w").over(onward)
    levelled = weighed.withColumn("_cap", cap).withColumn("_ratio", ratio).withColumn("_level", level).withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    final = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(final * F.col("_w"))
    return levelled.select(source, "source_size", target.alias("target"), "_capped")


def drawn(sizes: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED) -> DataFrame:
    """Per unit (doc, source, size): its rows ``_n``, source_size, target, and what ``taken`` reads.

    The sum of expected copies runs over rows: ``_before`` are the rows before the unit.
    """
    units = settle_table(sizes.groupBy(doc, source, size).agg(F.count(F.lit(1)).alias("_n")), "mix-units")
    totals = units.select(source, (F.col(size) * F.col("_n")).alias(size))
    targets = source_targets(totals, source, size)
    name = F.concat(F.lit(f"{seed}:"), F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), source)))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("_capped"), F.lit(float(MOST))).otherwise(F.col("target") / F.col("source_size"))
    # written, so that the join knows how many bytes they are
    targets = settle_table(targets.withColumn("_offset", offset).withColumn("_rate", rate).withColumnRenamed(source, "_source"), "mix-targets")
    ranked = ordered_scan(units.where(F.col(size) > 0), [source], [size, doc], {"_before": before("sum", "_n")})
    ranked = ranked.withColumn("_before", F.coalesce("_before", F.lit(0))).unionByName(units.where(F.col(size) == 0).withColumn("_before", F.lit(None).cast("long")))
    joined = ranked.join(targets, F.col(source).eqNullSafe(F.col("_source")))
    return joined.select(doc, source, size, "_n", "source_size", "target", "_before", "_offset", F.floor("_rate").alias("_whole"), (F.col("_rate") - F.floor("_rate")).alias("_part"))


def taken(row: Column) -> Column:
    """Copies of a unit's ``row`` (from 1): the whole ones, and one more where the sum crosses an integer."""
    place = F.col("_before") + row
    crossed = F.floor(F.col("_offset") + place * F.col("_part")) - F.floor(F.col("_offset") + (place - 1) * F.col("_part"))
    return F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.col("_whole") + crossed).cast("int")


def copies(sizes: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED) -> DataFrame:
    """A row per row of ``sizes``: doc, source, size, source_size, target and the ``copies`` to take of it."""
    each = drawn(sizes, doc, source, size, seed).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return each.select(doc, source, size, "source_size", "target", taken(F.col("_row")).alias("copies"))


def mix(df: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed rows of ``df``: each row as often as it is taken, all columns kept."""
    sized = df.withColumn("_mix_size", word_count(df[text]))
    names = {"doc_id": "_mix_doc", "source": "_mix_source", "size": "_mix_of"}
    units = settle_table(drawn(sized.select(df[doc].alias("doc_id"), df[source].alias("source"), F.col("_mix_size").alias("size")), seed=seed).drop("source_size", "target").withColumnsRenamed(names), "mix-drawn")
    match = sized[doc].eqNullSafe(F.col("_mix_doc")) & sized[source].eqNullSafe(F.col("_mix_source")) & (F.col("_mix_size") == F.col("_mix_of"))

    def out(rows: DataFrame, row: Column) -> DataFrame:
        counted = rows.withColumn("_mix_copies", taken(row)).where("_mix_copies > 0")
        return counted.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[sized[c] for c in df.columns])

    # each unit's last row crosses what is left of it: units without a copy need no text
    some = (F.col("_whole") > 0) | (F.floor(F.col("_offset") + (F.col("_before") + F.col("_n")) * F.col("_part")) > F.floor(F.col("_offset") + F.col("_before") * F.col("_part")))
    wanted = units.where(F.col("_before").isNotNull() & some)
    single = out(sized.join(wanted.where("_n = 1"), match), F.lit(1))
    several = wanted.where("_n > 1")
    if not several.limit(1).count():
        return single
    # rows of one id, source and size are told apart by their text
    joined = sized.join(several, match).withColumn("_mix_digest", F.xxhash64(sized[text]))
    numbered = ordered_scan(joined.withColumn("_mix_row_of", F.struct(*[sized[c] for c in df.columns])).select("_mix_row_of", "_mix_doc", "_mix_source", "_mix_of", "_mix_digest", "_before", "_offset", "_whole", "_part"), ["_mix_doc", "_mix_source", "_mix_of"], ["_mix_digest"], {"_mix_row": number()})
    counted = numbered.withColumn("_mix_copies", taken(F.col("_mix_row"))).where("_mix_copies > 0")
    return single.union(counted.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("_mix_row_of.*"))
