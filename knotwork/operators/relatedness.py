"""How related two pages are, by the links that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as me
from ..storage import stored
from .graph import in_degree, multiplicities, out_degree

MEASURES = ("in_vector", "out_vector", "in_distance", "out_distance")


def vectors(link: DataFrame, n_articles: int) -> tuple[DataFrame, DataFrame]:
    """(dir, page_id, link, w): weights of each page's neighbours, and (dir, page_id, size): how many there are."""
    arms = multiplicities(link)
    degree = in_degree(link).select(F.lit("in").alias("dir"), F.col("page_id").alias("link"), F.col("n").alias("degree"))
    degree = degree.unionByName(out_degree(link).select(F.lit("out").alias("dir"), F.col("page_id").alias("link"), F.col("n").alias("degree")))
    weighted = arms.join(degree, ["dir", "link"]).select("dir", "page_id", "link", me.link_weight(F.col("cnt"), F.col("most"), F.col("degree"), F.lit(n_articles)).alias("w"))
    return weighted, arms.groupBy("dir", "page_id").agg(F.count("*").alias("size"))


def common_links(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """(a, b, dir, common, dot, square_a, square_b) of pairs (a, b) that share links. Of each pair the page with fewer
    links is expanded to them, so a hub costs its partners' links and not its own."""
    sizes = weighted.groupBy("dir", "page_id").agg(F.count("*").alias("n"))
    size = lambda side: sizes.select("dir", F.col("page_id").alias(side), F.col("n").alias(f"n_{side}"))
    sided = pairs.select("a", "b").join(size("a"), "a").join(size("b"), ["dir", "b"])
    flip = F.col("n_a") > F.col("n_b")
    sided = sided.select("a", "b", "dir", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("many"))
    few = weighted.select(F.col("page_id").alias("few"), "dir", "link", F.col("w").alias("w_few"))
    many = weighted.select(F.col("page_id").alias("many"), "dir", "link", F.col("w").alias("w_many"))
    met = sided.join(few, ["dir", "few"]).join(many, ["dir", "many", "link"])
    first = F.col("few") == F.col("a")
    return link_sums(met.select("a", "b", "dir", F.when(first, F.col("w_few")).otherwise(F.col("w_many")).alias("wa"), F.when(first, F.col("w_many")).otherwise(F.col("w_few")).alias("wb")))


#: Pages of a class in one row, about.
CHUNK = 512


def page_classes(weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """weighted of one page of each class, the smallest, and (c, pages): the members of class c in rows of about CHUNK.
    Pages of a class have the same links of the same weights both ways, told by their number and two sums of hashes."""
    row = ["dir", "link", "w"]
    total = lambda salt: F.sum(F.xxhash64(*row, F.lit(salt)).cast("decimal(20,0)")).alias(f"h{salt}")
    signed = stored(weighted.groupBy("page_id").agg(F.count("*").alias("n"), total(1), total(2)), "signatures")
    same = ["n", "h1", "h2"]
    first = stored(signed.groupBy(*same).agg(F.min("page_id").alias("c"), F.count("*").alias("k")), "classes")
    chunk = F.pmod(F.xxhash64("page_id"), F.ceil(F.col("k") / CHUNK))
    members = signed.join(first, same).groupBy("c", chunk.alias("part")).agg(F.collect_list("page_id").alias("pages")).drop("part")
    return weighted.join(first.select(F.col("c").alias("page_id")), "page_id", "left_semi"), stored(members, "members")


def members_of(pairs: DataFrame, members: DataFrame, sided: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Pairs (a, b), a <= b, of classes as pairs a < b of their pages. Rows of members are dealt out before they are
    expanded, so no task has a whole class. ``sided``: columns of a and of b that change places with the pages."""
    side = lambda x: members.select(F.col("c").alias(x), F.col("pages").alias(f"_{x}s"))
    spark = pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    met = pairs.join(side("a"), "a").join(side("b"), "b").repartition(n, "a", "b", F.col("_as")[0], F.col("_bs")[0])
    rows = met.withColumn("_x", F.explode("_as")).drop("_as").withColumn("_y", F.explode("_bs")).drop("_bs")
    rows = rows.where("a < b or _x < _y").withColumn("_turned", F.col("_x") > F.col("_y"))
    turned = {}
    for p, q in sided:
        turned |= {p: F.when(F.col("_turned"), F.col(q)).otherwise(F.col(p)), q: F.when(F.col("_turned"), F.col(p)).otherwise(F.col(q))}
    return rows.withColumns(turned | {"a": F.least("_x", "_y"), "b": F.greatest("_x", "_y")}).drop("_x", "_y", "_turned")


def class_links(weighted: DataFrame) -> DataFrame:
    """common_links of every pair a <= b that shares a link: the links are joined, and no pairs are asked for."""
    of_a = weighted.select(F.col("page_id").alias("a"), "dir", "link", F.col("w").alias("wa"))
    of_b = weighted.select(F.col("page_id").alias("b"), "dir", "link", F.col("w").alias("wb"))
    return link_sums(of_a.join(of_b, ["dir", "link"]).where("a <= b"))


def all_common_links(weighted: DataFrame) -> DataFrame:
    """common_links of every pair a < b that shares a link. Links meet once for each two classes of pages, so only the
    rows that are asked for grow with the square of a link's pages, and none of them is shuffled."""
    of_classes, members = page_classes(weighted)
    return members_of(stored(class_links(of_classes), "class_links"), members, (("square_a", "square_b"),))


def link_sums(met: DataFrame) -> DataFrame:
    sums = [F.count("*").alias("common"), F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wa") * F.col("wa")).alias("square_a"), F.sum(F.col("wb") * F.col("wb")).alias("square_b")]
    return met.groupBy("a", "b", "dir").agg(*sums)


def compare(pairs: DataFrame | None, weighted: DataFrame, sizes: DataFrame, n_articles: int) -> DataFrame:
    """(a, b, in_vector, out_vector, in_distance, out_distance, mean) of distinct pairs a < b; of all that share a link
    where none are given."""
    lowest = me.lowest_similarity(n_articles)
    if pairs is None:  # pages of a class have the same measures
        of_classes, members = page_classes(weighted)
        shared = class_links(of_classes)
    else:
        shared = common_links(pairs, weighted)
    size = lambda side: sizes.groupBy(F.col("page_id").alias(side)).agg(*(F.max(F.when(F.col("dir") == d, F.col("size"))).alias(f"{d}_{side}") for d in ("in", "out")))
    flat = shared.groupBy("a", "b").agg(*(F.max(F.when(F.col("dir") == d, F.struct("common", "dot", "square_a", "square_b"))).alias(d) for d in ("in", "out")))
    rows = flat if pairs is None else pairs.select("a", "b").join(flat, ["a", "b"], "left")
    rows = rows.join(size("a"), "a", "left").join(size("b"), "b", "left")

    def similarity(d: str):
        n = lambda c: F.coalesce(c, F.lit(0))
        plain = me.link_similarity(n(F.col(f"{d}_a")), n(F.col(f"{d}_b")), n(F.col(f"{d}.common")), F.lit(n_articles))
        return me.rescaled(plain, lowest).alias(f"{d}_distance")

    vector = [F.coalesce(me.cosine(F.col(f"{d}.dot"), F.col(f"{d}.square_a"), F.col(f"{d}.square_b")), F.lit(0.0)).alias(f"{d}_vector") for d in ("in", "out")]
    out = rows.select("a", "b", *vector, similarity("in"), similarity("out"))
    out = out.withColumn("mean", sum(F.col(m) for m in MEASURES) / 4)
    return members_of(stored(out, "class_measures"), members) if pairs is None else out


def both_ways(compared: DataFrame) -> DataFrame:
    """Measures are symmetric: (a, b) also as (b, a)."""
    return compared.select("a", "b", *MEASURES, "mean").unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b"), *MEASURES, "mean"))


def to_context(pages: DataFrame, context: DataFrame, compared: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, page_id, one mean per measure, relatedness) of pages (doc_id, page_id) to the pages (doc_id, page_id,
    weight) of their context. A page counts 0 against itself, and 0 throughout where the context is empty or has no
    weight. ``compared``: measures both ways."""
    sizes = context.groupBy(by).agg(F.count("*").alias("_n"), F.sum("weight").alias("_quality"))
    met = pages.join(context.select(by, F.col("page_id").alias("b"), "weight"), by).withColumn("a", F.col("page_id"))
    met = met.join(compared, ["a", "b"], "left")
    sums = [F.sum(F.coalesce(m, F.lit(0.0))).alias(m) for m in MEASURES]
    rows = met.groupBy(by, "page_id").agg(*sums, F.sum(F.coalesce(F.col("mean") * F.col("weight"), F.lit(0.0))).alias("relatedness"))
    rows = pages.select(by, "page_id").distinct().join(rows, [by, "page_id"], "left").join(sizes, by, "left")
    live = F.col("_quality") > 0
    return rows.select(by, "page_id", *(F.when(live, F.col(m) / F.col("_n")).otherwise(0.0).alias(m) for m in (*MEASURES, "relatedness")))


def pairs_within(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Distinct unordered pairs (a, b), a < b, of pages that share a document; ``rows`` has at most as many pages a
    document as the candidate cap."""
    a, b = rows.select(by, F.col("page_id").alias("a")), rows.select(by, F.col("page_id").alias("b"))
    return a.join(b, by).where("a < b").select("a", "b").distinct()
