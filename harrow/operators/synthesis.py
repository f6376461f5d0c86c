"""Material for evaluation: mirrors, passages, document pairs. Sampling is by hash order, so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens


def hash_order(seed: int, *cols: Column | str) -> Column:
    """A repeatable pseudo-random key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def sample_per_group(rows: DataFrame, group: str, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows of each group without replacement."""
    order = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def mirror_text(text: Column, doc_id: Column, drop: float, seed: int) -> Column:
    """The text without about ``drop`` of its paragraphs; lead, headings and blank lines stay."""
    lines = F.split(text, "\n")
    headings = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("=="), i)), lambda i: i.isNotNull())
    lead = F.coalesce(F.array_min(headings), F.size(lines))
    dice = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    keep = lambda x, i: (i < lead) | x.startswith("==") | (strip(x) == "") | (dice(i) >= drop)
    return F.array_join(F.filter(lines, keep), "\n")


def mirrors(docs: DataFrame, per_topic: int = 2, drop: float = 0.2, seed: int = 7, source: str = "wikipedia") -> DataFrame:
    """Near copies of ``per_topic`` documents of each topic: (doc_id, title, text, source_uri, metadata), tagged ``duplicate_of``.

    ``docs``: doc_id, title, text, source_uri, metadata with source and topic. Only documents of ``source`` are mirrored.
    """
    own = docs.where(F.col("metadata")["source"] == source).withColumn("_topic", F.col("metadata")["topic"])
    picked = sample_per_group(own, "_topic", per_topic, seed)
    extra = F.create_map(F.lit("source"), F.lit("mirror"), F.lit("duplicate_of"), F.col("doc_id").cast("string"))
    rest = F.map_filter("metadata", lambda k, v: ~k.isin("source", "duplicate_of"))
    return picked.select(F.concat(F.lit("mirror:"), F.col("doc_id").cast("string")).alias("doc_id"), "title", mirror_text(F.col("text"), F.col("doc_id"), drop, seed).alias("text"), "source_uri", F.map_concat(rest, extra).alias("metadata"))


def passages(docs: DataFrame, least_chars: int = 300, whole_source: str = "arxiv", id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, line, passage): lines long enough to ask about that are no headings; the whole text where the source is ``whole_source``."""
    whole = F.col(source) == whole_source
    lines = F.when(whole, F.array(F.col(text))).otherwise(F.split(text, "\n"))
    rows = docs.select(id_col, F.coalesce(whole, F.lit(False)).alias("whole"), F.posexplode(lines).alias("line", "raw")).withColumn("passage", strip("raw"))
    good = (F.length("passage") >= least_chars) & ~F.col("passage").startswith("=")
    return rows.where(F.col("whole") | good).select(id_col, F.col("line").cast("bigint").alias("line"), "passage")


def sample_passages(docs: DataFrame, per_document: int = 2, seed: int = 13, **options) -> DataFrame:
    id_col = options.get("id_col", "doc_id")
    order = Window.partitionBy(id_col).orderBy(hash_order(seed, id_col, "line"), "line")
    return passages(docs, **options).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_document).drop("_r")


def multihop_pairs(docs: DataFrame, per_topic: int = 5, seed: int = 13, id_col: str = "doc_id", topic: str = "topic") -> DataFrame:
    """(topic, first, second): ``per_topic`` pairs of documents of one topic, first < second, each as likely.

    Pairs are drawn by their numbers and not listed: with documents numbered within the
    topic, draw ``d`` picks two distinct numbers from a hash; the first ``per_topic``
    distinct pairs count (all pairs where there are no more).
    """
    numbered = docs.select(topic, id_col).distinct().withColumn("i", F.row_number().over(Window.partitionBy(topic).orderBy(id_col)) - 1)
    sizes = numbered.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    few = F.col("pairs") <= per_topic * 4
    draws = sizes.withColumn("d", F.explode(F.when(few, F.sequence(F.lit(0).cast("bigint"), F.col("pairs") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.lit(per_topic * 8 - 1).cast("bigint")))))
    h = hash_order(seed, topic, "d")
    number = F.when(few, F.col("d")).otherwise(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") % F.col("pairs"))
    drawn = draws.withColumn("p", number).groupBy(topic, "p").agg(F.min("d").alias("d"), F.first("n").alias("n"))
    order = Window.partitionBy(topic).orderBy(F.when(F.col("n") * (F.col("n") - 1) / 2 <= per_topic * 4, hash_order(seed, topic, "p")).otherwise(F.format_string("%020d", "d")), "p")
    best = drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_topic)
    # Pair number p is (a, b) with b (b - 1) / 2 + a = p, a < b.
    b = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("bigint")
    best = best.withColumn("b", b).withColumn("a", F.col("p") - F.col("b") * (F.col("b") - 1) / 2).withColumn("a", F.col("a").cast("bigint"))
    first = numbered.select(topic, F.col("i").alias("a"), F.col(id_col).alias("first"))
    second = numbered.select(topic, F.col("i").alias("b"), F.col(id_col).alias("second"))
    return best.join(first, [topic, "a"]).join(second, [topic, "b"]).select(topic, "first", "second")


ANCHOR = 3


def containing(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "query_id", item_text: str = "text") -> DataFrame:
    """(item, id): the documents whose text holds an item's text.

    All terms of an item but its first and last stand whole in such a document, so the
    two must share the item's longest run of ``ANCHOR`` of these. Runs are met by hash
    where documents are read; only the pairs that share one are compared. An item too
    short for a run is compared with every document. Nulls hold nothing.
    """
    runs = lambda t, first, last: F.transform(F.sequence(first, last), lambda i: F.xxhash64(*[F.element_at(t, (i + j).cast("int")) for j in range(ANCHOR)]))
    asked = items.where(F.col(item_text).isNotNull()).select(item_col, F.col(item_text).alias("item_text"), tokens(item_text).alias("t")).withColumn("n", F.size("t"))
    long = F.col("n") >= ANCHOR + 2
    sizes = F.transform(F.sequence(F.lit(2), F.col("n") - ANCHOR), lambda i: F.struct(F.length(F.array_join(F.slice("t", i, ANCHOR), "")).alias("size"), i.alias("at")))
    place = F.array_max(sizes)["at"]
    anchored = asked.where(long).withColumn("at", place).select(item_col, "item_text", F.xxhash64(*[F.element_at("t", (F.col("at") + j).cast("int")) for j in range(ANCHOR)]).alias("run"))
    bodies = docs.where(F.col(text).isNotNull()).select(id_col, F.col(text).alias("body"))
    parts = bodies.select(id_col, "body", tokens("body").alias("t")).where(F.size("t") >= ANCHOR)
    met = parts.select(id_col, "body", F.explode(F.array_distinct(runs(F.col("t"), F.lit(1), F.size("t") - (ANCHOR - 1)))).alias("run")).join(anchored, "run")
    found = met.where(F.col("body").contains(F.col("item_text"))).select(item_col, id_col)
    short = asked.where(~long).select(item_col, "item_text")
    return found.unionByName(bodies.join(short, F.col("body").contains(F.col("item_text"))).select(item_col, id_col))
