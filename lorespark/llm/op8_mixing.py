"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source first takes its complete epochs: as many whole passes as its target
holds. The rest of the target is a weighted sample without replacement: each
document draws an exponential key divided by its quality weight, keys are
sorted within the source, and sizes are summed up to the token budget. All of
it is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Collection

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import WORD_RULE, named, stage, text_of
from lorespark.session import prepare

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Most passes over a source.
PASSES = 3
#: Parts that a source's keys are summed in before any is sorted.
PARTS = 4096


@F.arrow_udf(T.LongType())
def _count_words(texts: pa.Array) -> pa.Array:
    # Arrow's ASCII white space is that of WORD_RULE; an empty text splits into one empty word
    trimmed = pc.ascii_trim_whitespace(texts)
    words = pc.list_value_length(pc.ascii_split_whitespace(trimmed))
    return pc.if_else(pc.equal(trimmed, ""), 0, words).cast(pa.int64())


def words_in(text: Column) -> Column:
    """Number of words (``WORD_RULE``) of a text; null has none.

    Arrow splits texts in a quarter of the time of ``regexp_count``.
    """
    return F.coalesce(_count_words(text.cast("string")), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``.

    Sources by code point, null last, take their weights in turn and share
    the sum of all sizes. No target exceeds ``passes`` times its source: what
    is above is shared anew by weight. That is one level t with target
    min(cap, t * weight); sources are capped in order of cap / weight, so the
    level follows from running sums over the source table.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", turn.cast("double"))
    capped = ranked.withColumn("cap", F.col("source_size") * passes).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("cap").over(rising), F.lit(0))) / F.sum("weight").over(rest)
    # levels rise up to the first source above its level and fall behind it
    with_level = capped.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", level)
    final = with_level.withColumn("t", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    share = F.when(F.col("t").isNull() | (F.col("ratio") <= F.col("t")), F.col("cap").cast("double")).otherwise(F.col("t") * F.col("weight"))
    return final.select("source", "source_size", share.alias("target"))


def unit_interval(*columns: Column) -> Column:
    """A number in (0, 1) fixed by the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(8), *columns), 12) + F.lit(0.5)) / float(1 << 52)


def exponential_key(weight: Column, *columns: Column) -> Column:
    """Efraimidis-Spirakis key of a row; smaller ones are taken first.

    A whole number, so that it is the same whenever it is computed.
    """
    return F.floor(-F.log(unit_interval(*columns)) / weight * float(1 << 32)).cast("long")


def mix_sources(
    docs: DataFrame, quality: Column, ident: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, keep: Collection[str] | None = None,
) -> DataFrame:
    """The input columns with size, source_size, target and taken (words).

    ``keep`` names the input columns to return, all if None. Without the text
    they are written once with sizes and keys, so that texts are read and cut
    once; with it, no text is written, but sizes and keys are computed twice.

    ``quality`` is the positive sampling weight of a row, 1 if null. The
    document at the edge of a budget is taken in part, so a source takes its
    target to the word; rows with equal keys (repeated rows) share the edge.
    Keys depend on the id, the text and the weight alone, so reruns agree.
    Null and empty texts have size 0 and take 0; repeated rows count each; an
    empty table gives an empty table; input columns named like a new one are
    replaced. Runs a job for the sizes.
    """
    prepare(docs.sparkSession)
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if keep is None or c in keep]
    names = [c for c in kept if c.lower() not in new or c in (ident, text, source)]
    weight = F.greatest(F.coalesce(quality.cast("double"), F.lit(1.0)), F.lit(1e-6))
    rows = docs.select(
        F.struct(*[named(docs, c) for c in names]).alias("_row"),
        named(docs, source).alias("source"),
        words_in(named(docs, text)).alias("size"),
        exponential_key(weight, named(docs, ident), text_of(docs, text)).alias("key"),
    )
    # parts follow the order of the keys; exp(-key) spreads them evenly
    part = F.floor((1 - F.exp(-F.col("key") / float(1 << 32))) * PARTS)
    sized = rows.withColumn("part", part)
    if text in names:
        sized = stage(sized.drop("_row"), "sizes")
    else:
        rows = sized = stage(sized, "sizes")
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("size"))
    wanted = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("epochs", epochs.cast("long"))
    wanted = wanted.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    def edge(groups: DataFrame, budgets: DataFrame, by: str) -> DataFrame:
        """The group of a source in which its budget ends, and what is left for it."""
        running = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        summed = groups.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)))
        return (
            summed.alias("a").join(budgets.alias("w"), F.expr("a.source <=> w.source"))
            .filter("a.ahead < w.budget and a.ahead + a.size >= w.budget")
            .select("w.source", f"a.{by}", F.col("a.size").alias("edge_size"), (F.col("w.budget") - F.col("a.ahead")).alias("budget"))
        )

    parts = edge(sums, wanted.select("source", "budget"), "part").drop("edge_size")
    inside = sized.alias("s").join(parts.alias("p"), F.expr("s.source <=> p.source and s.part = p.part"), "left_semi")
    keys = edge(inside.groupBy("source", "key").agg(F.sum("size").alias("size")), parts.drop("part"), "key")
    plan = wanted.drop("budget").alias("w").join(keys.alias("k"), F.expr("w.source <=> k.source"), "left").select(
        "w.*", F.col("k.key").alias("edge"), "edge_size", "budget"
    )
    plan = stage(plan, "source_plan")  # one row for each source
    key = F.col("r.key")
    extra = F.when(key < F.col("edge"), F.col("size")).when(
        key == F.col("edge"), F.floor(F.col("size") * F.col("budget") / F.col("edge_size")).cast("long")
    ).otherwise(F.lit(0))
    return rows.alias("r").join(plan.alias("w"), F.expr("r.source <=> w.source")).select(
        "_row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken")
    )


def text_quality(text: Column) -> Column:
    """A weight in (0, 1]: the share of characters that are no mark-up signs, to the eighth."""
    # signs are few: counting them is faster than building the text without them
    plain = F.length(text) - F.regexp_count(text, F.lit(r"[#*$%&|<>{}\[\]\\^~=]"))
    return F.when(F.length(text) > 0, F.pow(plain / F.length(text), 8)).otherwise(1.0)


def take_words(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken.

    A document taken in part ends with its first words, joined by one space.
    """
    rest = F.col("taken") % F.col("size")
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    copies = mixed.filter(F.col("taken") > 0).withColumn("_turn", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    part = (F.col("_turn") * F.col("size") > F.col("taken")) & (rest > 0)
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD_RULE), F.lit(0)), 1, F.greatest(rest, F.lit(1)).cast("int"))
    return copies.withColumn(text, F.when(part, F.array_join(words, " ")).otherwise(F.col(text))).drop("_turn")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, text_quality(F.col("text")), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
