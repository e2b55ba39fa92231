"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in code-point order with null last, weigh 1, 2, 3, 1, ... and share all words. A target stops at three times the words of
its source; the excess is shared again by weight until no target is above. A source gives as many complete epochs
as fit its target, and the rest from a weighted sample: every document draws an exponential key scaled by its quality
weight, documents are taken in key order, and the words of the earlier ones are summed up to the rest.
The document at the edge is taken if that brings the sum nearer to the target (half or more of it fits).

No window spans a source. Keys are filed into buckets of near-equal size; bucket sums locate the edge,
and only the bucket it falls into is ordered. Only DataFrame operations are used.

A null text has size 0 and is never taken; a row without an id draws by its text. Rows that are equal in id and text draw the same
key and stand next to each other. Draws are digests of the id: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.frames import WORD_BYTES, match_rows, row_key
from rowloom.session import join_bounded, stage_small, write_stage

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
BUCKET_ROWS = 10_000          # rows of one source's bucket that one task orders, about
LEAST_BUCKETS, MOST_BUCKETS = 256, 1 << 24


def sizes(docs: DataFrame) -> F.Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD_BYTES)), F.lit(0)).cast("bigint")


def source_order(sizes_by_source: DataFrame) -> DataFrame:
    """Add `place`, 0-based in code-point order with null last, without ordering all sources in one task.

    Sources are counted by their first four characters; offsets of these few groups are summed, and places are numbered inside.
    """
    head = F.coalesce(F.substring("source", 1, 4), F.lit(""))
    grouped = sizes_by_source.withColumn("_last", F.col("source").isNull().cast("int")).withColumn("_head", head)
    heads = grouped.groupBy("_last", "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_last", "_head").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("_last", "_head", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_last", "_head").orderBy("source")) - 1
    return grouped.join(heads, ["_last", "_head"]).withColumn("place", F.col("_before") + inside).drop("_last", "_head", "_before")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size); the driver sees three sums per round."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = write_stage(source_order(totals).withColumn("weight", weight).select("source", "source_size", "weight"), "sources")
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most = (F.col("source_size") * MOST_EPOCHS).cast("double")

    def share(rest: int, weights: int) -> F.Column:
        return F.col("weight").cast("bigint") * F.lit(rest) / F.lit(max(weights, 1))

    free, capped = None, F.lit(False)
    while True:  # every round caps at least one more source
        sums = placed.agg(F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0))).first()
        now = (total - MOST_EPOCHS * sums[1], sums[0])
        if now == free:
            break
        free, capped = now, most <= share(*now)
    target = F.when(capped, most).otherwise(share(*free))
    return placed.select("source", "source_size", target.alias("target"))


def draw_key(weight: str) -> F.Column:
    """Exponential key of rate `weight`, drawn from the id, or without one from the digest of the text."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("text_key").cast("string")))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    return -F.log(uniform) / F.col(weight)


def mix(sized: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, taken) from (doc_id, text_key, source, size, weight).

    `text_key` orders rows with one id; `weight` (1 to 2, the quality of the document) scales its key.
    """
    keyed = write_stage(sized.withColumn("key", draw_key("weight")), "keyed")
    goal = write_stage(targets(keyed).withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")}).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    rows = keyed.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (rows // BUCKET_ROWS).bit_length()))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("bigint")
    filed = keyed.withColumn("bucket", bucket)
    summed = filed.groupBy("source", "bucket").agg(F.sum("size").alias("inside"))
    before = F.sum("inside").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    summed = summed.withColumn("before", F.coalesce(before, F.lit(0)))
    same = F.col("g.source").eqNullSafe(F.col("b.source"))
    edge = summed.alias("b").join(goal.alias("g"), same).filter("before <= rest AND rest < before + inside")
    edge = edge.select("g.source", "bucket", "before", "rest")
    goal = goal.alias("g").join(edge.select("source", "bucket", "before").alias("b"), same, "left").select(
        "g.*", F.col("bucket").alias("edge"), "before")
    small, fits = stage_small(goal, "edges")
    small = small.withColumnRenamed("source", "_source")
    joined = join_bounded(filed.withColumn("_source", F.col("source")).withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}),
                          small.withColumns({"_null": F.col("_source").isNull(), "_source": F.coalesce("_source", F.lit(""))}), ["_source", "_null"], fits)
    at_edge = joined.filter("bucket = edge")
    order = Window.partitionBy("_source", "_null").orderBy("key", "doc_id", "text_key")
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at_edge = at_edge.withColumn("_so_far", F.col("before") + F.coalesce(so_far, F.lit(0))).withColumn(
        "extra", F.col("_so_far") + F.col("size") / 2 <= F.col("rest"))
    others = joined.filter("edge IS NULL OR bucket <> edge").withColumn("extra", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    columns = ["doc_id", "text_key", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra").cast("int"))).alias("taken")]
    return others.select(*columns).unionByName(at_edge.select(*columns))


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size, weight): labelled good 2, labelled poor 1, unlabelled 1.5."""
    graded = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", sizes(docs).alias("size"))
    weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 1.0).otherwise(1.5)
    return sized.join(graded, "doc_id", "left").select("doc_id", "text_key", "source", "size", weight.alias("weight"))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the mix takes, with `copies`, `taken`, `size`, `source_size` and `target`; documents not taken go."""
    taken = mix(quality_weights(docs, labels)).filter("taken > 0").withColumn("copies", (F.col("taken") / F.col("size")).cast("int"))
    mixed = taken.select(row_key("text_key").alias("row"), F.struct("taken", "size", "source_size", "target", "copies").alias("mixed"))
    joined = match_rows(docs, mixed.groupBy("row").agg(F.max("mixed").alias("mixed")), "inner", "mixed")
    held = f"`{joined.columns[-1]}`"
    own = {c.lower() for c in docs.columns}
    return joined.select(*[f"`{c}`" for c in docs.columns], *[F.col(f"{held}.{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies") if c not in own])
