"""Mixing sources to target weights, to the word.

Documents get a hash-random key. Within a source they are ordered by it: key ranges of equal width, about as many as
the square root of the source's documents, are sorted each on its own, and the ranges' sums give every range its
offset. So the prefix sum of words over a source of any size needs no task that sees the whole source. A source gives
its whole self as often as its budget allows, then its first documents up to the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED, unused, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own words.
EPOCHS = 3


def n_words(text: Column) -> Column:
    """SPACED words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sources(source, source_size, n): with `target`, `budget` (the target in whole words) and `ranges`.

    Fills by weight until a source's cap, epochs * source_size, stops it: with sources ordered by cap per weight, the
    level is the highest at which no later source is above its cap. There is a row per source, so a plain window serves,
    which one task computes: a million sources are some tens of MB.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(full), F.lit(0))
    level = ((F.sum("source_size").over(every) - before("cap")).cast("double") / (F.sum("w").over(every) - before("w")).cast("double")).alias("level")
    levels = weighed.select("*", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    return (
        levels.withColumn("target", F.coalesce(F.least(F.col("w") * F.col("level"), F.col("cap").cast("double")), F.lit(0.0)))
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("ranges", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"))
        .select("source", "source_size", "target", "budget", "ranges")
    )


def plan(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, budget, taken, and the columns to carry under `__c_NAME`.

    `taken` counts words with repeats: the whole document once per whole epoch, and once more, or in part if the budget
    ends inside it, in the last. Rows whose source is null are a source, the last. Null and empty texts have no words
    and give none; long ones count whole. The order's key is a hash of id and text, so rows that share an id, or have
    none, spread like any others; rows that repeat id and text tie, are equal, and follow each other. With no words at
    all, all targets are zero. An empty table gives an empty one. Columns of docs may have any names.
    """
    carry = carry or []
    text_hash = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text_hash).cast("binary"))
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size"), key.alias("__key"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    # What is carried may be whole texts, which aren't written once more for it.
    sized = sized if carry else written(sized)
    narrow = written(sized.select("__source", "__key", "__size")) if carry else sized
    per = written(targets(narrow.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count("*").alias("n")), weights, epochs))
    spot = F.shiftright(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32)
    of = lambda df: df.join(per, F.col("__source").eqNullSafe(F.col("source"))).withColumn("__range", spot)
    sums = of(narrow).groupBy("source", "__range").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("source", "__range").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = of(sized).withColumn("__sum", F.sum("__size").over(inside))
    placed = run.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    taken = whole * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__offset") - F.col("__sum") + F.col("__size")))
    return placed.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "budget", taken.cast("long").alias("taken"), *(f"__c_{c}" for c in carry))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself: a row per document and epoch, with the columns of docs, `epoch` (from 1) and `words`.

    The text is whole but where a source's budget ends inside a document; that copy is cut after its last word taken.
    Where docs has columns of these two names, ours get underscores before them. Odd rows as in `plan`; documents
    without words are in no mix.
    """
    epoch, n = unused(docs.columns, "epoch", "words")
    out = plan(docs, docs.columns, id_col=id_col, text_col=text_col).where("taken > 0")
    each = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    cut = F.col("words") < F.col("size")
    pieces = F.split(F.col(f"__c_{text_col}"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a word with the space before it
    each = each.withColumn("words", words).withColumn("__cut", F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")))
    columns = [
        F.coalesce(F.col("__cut"), F.col(f"__c_{c}")).alias(c)
        if c == text_col
        else F.coalesce(F.length("__cut"), F.col(f"__c_{c}")).cast(docs.schema[c].dataType).alias(c)
        if c == chars_col
        else F.col(f"__c_{c}").alias(c)
        for c in docs.columns
    ]
    return each.select(*columns, F.col("epoch").alias(epoch), F.col("words").alias(n))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's digest of `plan`, which says what becomes of odd rows."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
