"""Labels for training: weights, scores, splits, routing, voting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import truncated


def class_weights(rows: DataFrame, label: str, lo: float = 0.2, hi: float = 5.0) -> DataFrame:
    """[D22, H35] Inverse-frequency weights n / (classes * count), clamped."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row for each class
    return counted.select("label", "n", F.round(F.greatest(F.lit(lo), F.least(F.lit(hi), F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))), 6).alias("weight"))


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """[D23] Mean F1 of the classes that occur; rows without a truth are masked. One pass over the pairs' counts."""
    pairs = rows.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).cast("long").alias("b")), F.struct(F.col("g").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("b")))).alias("x")).select("x.*").where("c IS NOT NULL")
    by = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("b").alias("b"))
    return by.select((2.0 * F.col("b") / (F.col("t") + F.col("g"))).alias("f1")).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def split_by_outlet(articles: DataFrame, held_out: list[int], labels: list[str]) -> DataFrame:
    """[H33, H34] Label ids (-1: masked), the reason for a masked row and the split by held-out outlets; counted."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("tf_topic"))
    rows = articles.select(F.when(F.col("outlet_id").isin(held_out), "test").otherwise("train").alias("split"), F.coalesce(F.when(place > 0, place - 1), F.lit(-1)).cast("int").alias("label_id"), F.when(F.col("tf_topic").isNull(), "unlabelled").when(place == 0, "out_of_scope").alias("reason"))
    return rows.groupBy("split", "label_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def route_axes(articles: DataFrame, outlets: DataFrame, political: list[str]) -> DataFrame:
    """[H30] Which rule labels an article: fact-checkers are forced neutral, political topics go to the model, the rest has none."""
    kind = outlets.select(F.col("id").alias("outlet_id"), "outlet_type")
    route = F.when(F.col("outlet_type") == "fact_checker", "neutral").when(F.col("tf_topic").isin(political), "model")
    return articles.join(kind, "outlet_id").select("id", route.alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def oversampling_weights(rows: DataFrame, label: str, classes: int, boosted: Column) -> DataFrame:
    """[H35] (id, weight): rows / (classes * count of the label), twice that where ``boosted``; 1 without a label. The counts are one row a class."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    weights = counted.select("c", (F.sum("n").over(Window.partitionBy()) / (F.lit(classes) * F.col("n"))).alias("w"))
    marked = rows.select("id", F.col(label).alias("c"), F.coalesce(boosted, F.lit(False)).alias("b")).join(weights, "c", "left")
    return marked.select("id", F.round(F.when(F.col("w").isNull(), 1.0).otherwise(F.col("w") * F.when(F.col("b"), 2).otherwise(1)), 6).alias("weight"))


def articles_block(articles: DataFrame, key: str, n: int, limit: int = 800) -> DataFrame:
    """[G24] For each group the text of a prompt: its ``n`` earliest articles, numbered, with the kind of outlet, title and beginning.
    articles: key, id, published_on, outlet_type, title, content_text; the window cuts a group before its texts are gathered."""
    by = Window.partitionBy(key).orderBy("published_on", "id")
    first = articles.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    kind = F.coalesce(F.nullif("outlet_type", F.lit("")), F.lit("unknown"))
    text = F.concat(F.lit("Articol "), F.col("rn").cast("string"), F.lit(" ("), kind, F.lit("): "), bare(F.col("title")), F.lit("\n"), truncated(bare(F.col("content_text")), limit))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"])
    return first.groupBy(key).agg(F.array_join(parts, "\n\n").alias("block"))
