"""S9 (re-aimed): outlet ratings from stored web pages (no network).

(a) links inside list items / headings whose target starts with a prefix, the
    name stripped of a suffix; (b) bold ``name: number`` pairs, name
    lower-cased, value a double, pivoted to one row per page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.text import slug

LINK_PATTERN = r'<(?:li|h[1-6])><a href="([^"]*)">([^<]*)</a></(?:li|h[1-6])>'
PAIR_PATTERN = r"<p><(?:strong|b)>([^<:]+): ([-+0-9.]+)"


def page_links(pages: DataFrame, prefix: str = "/", suffix: str = " Bias and Reliability",
               pattern: str = LINK_PATTERN) -> DataFrame:
    """(page_id, href, name, slug)."""
    hrefs = F.regexp_extract_all("html", F.lit(pattern), 1)
    names = F.regexp_extract_all("html", F.lit(pattern), 2)
    links = pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), names.alias("name"))).alias("pos", "l"))
    links = links.where(F.col("l.href").startswith(prefix))
    name = F.replace(F.col("l.name"), F.lit(suffix), F.lit(""))
    return links.select("page_id", "pos", F.col("l.href").alias("href"), name.alias("name"), slug(name).alias("slug"))


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title, h1, same): title and first heading of each page."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    h1 = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    return pages.select("page_id", title.alias("title"), h1.alias("h1"), (title == h1).alias("same"))


def page_ratings(pages: DataFrame, metrics: Sequence[str] = ("reliability", "bias"),
                 pattern: str = PAIR_PATTERN) -> DataFrame:
    """(page_id, <metric>...): bold pairs pivoted; the listed metrics are the columns, the last pair of a name counts."""
    names = F.regexp_extract_all("html", F.lit(pattern), 1)
    vals = F.regexp_extract_all("html", F.lit(pattern), 2)
    pairs = pages.select("page_id", F.posexplode(F.arrays_zip(names.alias("n"), vals.alias("v"))).alias("pos", "p"))
    metric = F.lower(F.trim("p.n"))
    return pairs.groupBy("page_id").agg(*[
        F.max_by(F.when(metric == m, F.col("p.v").cast("double")), F.when(metric == m, F.col("pos"))).alias(m)
        for m in metrics])
