"""Pages of a site joined to one bounded text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def site_bundles(pages: DataFrame, key: str, order: str, path: str, text: str, status: str, head: int = 100, least_page: int = 80, most: int = 12_000, least: int = 200) -> DataFrame:
    """A row a site: usable pages (2xx or 3xx, `least_page` characters or more), of pages with equal beginnings the first, each under a header, cut to `most` characters.

    `failure` says why a site has too little text.  Only pages that begin within `most` characters are gathered, so a site of any number of pages fits.
    """
    reached = F.col(status).between(200, 399)
    usable = F.coalesce(reached & (F.length(text) >= least_page), F.lit(False))
    same = Window.partitionBy(key, "_head").orderBy(order)
    rows = pages.where(usable).withColumn("_head", F.sha1(F.substring(text, 1, head))).withColumn("_k", F.row_number().over(same)).where("_k = 1")
    block = F.concat(F.lit("## Page: /"), F.coalesce(F.col(path), F.lit("")), F.lit("\n\n"), F.col(text), F.lit("\n\n---\n\n"))
    rows = rows.select(key, order, block.alias("_block")).withColumn("_upto", F.sum(F.length("_block")).over(Window.partitionBy(key).orderBy(order)))
    joined = rows.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_upto") - F.length("_block") < most, F.struct(order, "_block")))), lambda x: x["_block"]), "").alias("_all"),
        F.max("_upto").alias("_size"),
        F.count("*").alias("pages_used"),
    )
    seen = pages.groupBy(key).agg(F.coalesce(F.bool_or(reached), F.lit(False)).alias("_any"))
    out = seen.join(joined, key, "left")
    content = F.coalesce(F.substring("_all", 1, most), F.lit(""))
    return out.select(
        key,
        content.alias("content"),
        F.coalesce(F.col("_size") > most, F.lit(False)).alias("truncated"),
        F.coalesce("pages_used", F.lit(0)).alias("pages_used"),
        F.when(F.length(content) < least, F.when(F.col("_any"), "no_content").otherwise("all_pages_unreachable")).alias("failure"),
    )
