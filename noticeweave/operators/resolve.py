"""Entity resolution: keys, exact tiers, and a blocked similarity join of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import text as T
from noticeweave.operators.name_pairs import similar_in_cell
from noticeweave.session import checkpoint, parallelism

THRESHOLD = 0.72
#: Names of one side in a cell of the similarity join; families of related agencies beyond it are cut into slices.
CELL = 20_000


def with_keys(df: DataFrame) -> DataFrame:
    """Add ``name, batch, key, key_id`` from agency, year, title and programme name."""
    df = df.withColumn("name", T.normalize_name(F.col("title"), F.col("program_name"))).withColumn("batch", T.batch_of(F.col("title")))
    key = F.concat(F.coalesce("agency", F.lit("")), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("|"), "name", F.lit("|"), "batch")
    return df.withColumn("key", key).withColumn("key_id", F.substring(F.sha1("key"), 1, 12))


def similar_names(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, score)``: named groups of related agencies whose names are alike.

    Both sides have ``node, agency, name``. Agencies are related if one begins with the other; names are alike by
    ``text.dice``. Related agencies begin with the same shortest agency, so its names make a cell; a large cell is cut into
    slices of about ``CELL`` names, and each slice of one side meets each of the other. Which pairs are told doesn't
    depend on the cells. Null and empty names and agencies match nothing.
    """
    spark = left.sparkSession
    some = lambda df: df.where("agency <> '' and length(name) >= 2 and node is not null").select("node", "agency", "name")
    left, right = some(left), some(right)
    many = lambda df, n: df.groupBy("agency").agg(F.count(F.lit(1)).alias(n))
    agencies = checkpoint(many(left, "x").join(many(right, "y"), "agency", "full"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("agency")), lambda i: F.substring("agency", F.lit(1), i))
    roots = agencies.select("agency", F.explode(prefixes).alias("root")).join(agencies.select(F.col("agency").alias("root")), "root", "left_semi")
    roots = roots.groupBy("agency").agg(F.min_by("root", F.length("root")).alias("root"))
    slices = lambda c: F.ceil(F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1)) / CELL)
    cut = agencies.join(roots, "agency").groupBy("root").agg(slices("x").alias("xs"), slices("y").alias("ys"), F.sum(F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n"))
    cut = checkpoint(cut)
    whole = (F.col("xs") == 1) & (F.col("ys") == 1)
    cells = cut.agg(F.sum(F.when(~whole, F.col("xs") * F.col("ys"))).alias("cut"), F.sum(F.when(whole, F.col("n"))).alias("n")).first()
    small = (cells["n"] or 0) // (2 * CELL) + 1
    parts = max(parallelism(spark), min(2 * (small + (cells["cut"] or 0)), 1_000))
    cut = roots.join(cut, "root").select("agency", "root", "xs", "ys", whole.alias("whole"))

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        df = df.join(cut, "agency").withColumn(i, F.pmod(F.xxhash64("node"), F.col(own))).withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        df = df.withColumn("i", F.when(F.col("whole"), F.pmod(F.xxhash64("root"), F.lit(small))).otherwise(F.col("i"))).withColumn("cell", F.when(F.col("whole"), "").otherwise(F.col("root")))
        return df.repartition(parts, "cell", "i", "j").select([F.col(c).alias(c) for c in ("node", "agency", "name", "cell", "i", "j")])  # two sides may be one table

    key = ["cell", "i", "j"]
    kind = lambda df: df.schema["node"].dataType.simpleString()
    pairs = dealt(left, "xs", "ys", "i", "j").groupBy(*key).cogroup(dealt(right, "ys", "xs", "j", "i").groupBy(*key))
    pairs = pairs.applyInArrow(similar_in_cell(threshold), f"a {kind(left)}, b {kind(right)}, score double")
    return pairs.select("a", "b", F.round("score", 9).alias("score"))


def match_cascade(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc, match, tier)``: each document's record by programme (0), URL (1), key (2) or document number (3).

    ``docs`` has ``doc, urls, key, doc_no``, ``known`` has ``id, urls, key, doc_no``; the first of ``urls`` is the official one. A
    key that begins with ``program:`` is a pinned programme: only it matches by tier 0, other documents reach it by its official
    address alone. One join over tagged keys serves all tiers; empty and null keys match nothing. The lowest tier
    counts, and in it the smallest id. Documents without a match are kept with nulls.
    """
    pinned = F.coalesce(F.col("key").startswith("program:"), F.lit(False))
    no_urls = F.array().cast("array<string>")

    def keys(df: DataFrame, c: str, mine: bool) -> DataFrame:
        urls = F.array_distinct(F.array_compact(F.coalesce("urls", no_urls)))
        own = F.get(F.coalesce("urls", no_urls), F.lit(0))
        tag = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(name).alias("t"), v.alias("k")))
        shared = F.transform(urls, lambda u: tag("url", u))
        if mine:  # an ordinary page asks for programmes by its official address
            ordinary = F.concat(shared, F.array(tag("official", own), tag("key", F.col("key")), tag("no", F.col("doc_no"))))
            programme = F.concat(F.array(tag("programme", F.col("key"))), F.array(tag("url", own), tag("official", own), tag("any", own)))
        else:
            ordinary = F.concat(shared, F.array(tag("key", F.col("key")), tag("no", F.col("doc_no"))))
            programme = F.concat(F.array(tag("programme", F.col("key")), tag("official", own)), F.transform(urls, lambda u: tag("any", u)))
        return df.select(c, F.explode(F.array_compact(F.when(pinned, programme).otherwise(ordinary))).alias("x")).select(c, "x.t", "x.k")

    tiers = {"programme": 0, "url": 1, "official": 1, "any": 1, "key": 2, "no": 3}
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv]), F.col("t"))
    smallest = keys(known, "id", False).groupBy("t", "k").agg(F.min("id").alias("id"))
    hits = keys(docs, "doc", True).distinct().join(smallest, ["t", "k"]).groupBy("doc").agg(F.min(F.struct(tier.alias("tier"), "id")).alias("m"))
    return docs.select("doc").distinct().join(hits, "doc", "left").select("doc", F.col("m.id").alias("match"), F.col("m.tier").alias("tier"))


def match_similar(docs: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc, id)``: each document's record of a related agency, the same year and batch, and the most similar name.

    ``docs`` has ``doc, agency, year, name, batch``, ``known`` has ``id`` instead of ``doc``. A missing year (null or 0)
    agrees with any; where one is null, the batch need not agree either. Ties go to the smaller id.
    """
    node = F.concat("agency", F.lit("|"), "name")
    # Records that agree in all that counts are one; the smallest id stands for them.
    known = known.where("agency <> '' and name <> ''").groupBy("agency", "name", "year", "batch").agg(F.min("id").alias("id"))
    docs, known = checkpoint(docs.where("agency <> '' and name <> ''").withColumn("node", node)), checkpoint(known.withColumn("node", node))
    names = lambda df: df.select("node", "agency", "name").distinct()
    alike = similar_names(names(docs), names(known), threshold)
    k = known.select(F.col("node").alias("b"), F.col("year").alias("k_year"), F.col("batch").alias("k_batch"), "id")
    pairs = docs.withColumnRenamed("node", "a").join(alike, "a").join(k, "b")
    none = F.col("year").isNull() | F.col("k_year").isNull()
    same = (F.col("year") == F.col("k_year")) | (F.col("year") == 0) | (F.col("k_year") == 0)
    pairs = pairs.where(none | (same & (F.col("batch") == F.col("k_batch"))))
    return pairs.groupBy("doc").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("doc", "m.id")
