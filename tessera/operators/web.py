"""Links, URLs and crawl simulation over tables of pages."""

from __future__ import annotations

import html.parser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.storage import materialize

# The extensions of dynamic pages.
DYNAMIC = ("php", "asp", "aspx", "jsp", "cgi", "cfm", "do", "action", "py")
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every anchor with a quoted href, in document order, repeats kept."""
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(0))
    links = pages.select("page_id", F.posexplode(found).alias("pos", "tag"))
    quoted = F.regexp_extract("tag", HREF, 1)
    return links.select("page_id", "pos", F.when(quoted != "", quoted).otherwise(F.regexp_extract("tag", HREF, 2)).alias("href"))


class _Anchors(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [value for name, value in attrs if name == "href" and value is not None][:1]


def anchors(markup: str | None) -> list[str]:
    """The href of every anchor as a parser sees it: quoted or not, entities resolved, none from comments."""
    parser = _Anchors()
    parser.feed(markup or "")
    parser.close()
    return parser.found


@F.pandas_udf(ArrayType(StringType()))
def anchors_column(markup: pd.Series) -> pd.Series:
    """``anchors`` over a column."""
    return markup.map(anchors)


def parsed_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, simple, target) of every anchor by a parser, in document order; ``simple`` and ``target`` are its normal forms."""
    links = pages.select("page_id", "url", F.posexplode(anchors_column("html")).alias("pos", "href"))
    return links.select("page_id", "pos", "href", normalize_simple_column("url", "href").alias("simple"), normalize_column("url", "href").alias("target"))


def normalize_simple(base: str, href: str) -> str:
    """Without its fragment; absolute as it is, else joined to the base."""
    href = href.partition("#")[0]
    return href if urlparse(href).scheme else urljoin(base, href)


def normalize(base: str, href: str | None) -> str | None:
    """Without its fragment and joined to the base; None for nothing left or anything but http and https."""
    href = (href or "").partition("#")[0]
    try:
        if not href or (scheme := urlparse(href).scheme) and scheme not in ("http", "https"):
            return None
        full = urljoin(base, href)
    except ValueError:
        return None
    return full if full.startswith(("http://", "https://")) else None


@F.pandas_udf(StringType())
def normalize_simple_column(base: pd.Series, href: pd.Series) -> pd.Series:
    """``normalize_simple`` over columns; null where the reference is no URL at all."""

    def one(b: str, h: str) -> str | None:
        try:
            return normalize_simple(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(StringType())
def normalize_column(base: pd.Series, href: pd.Series) -> pd.Series:
    """``normalize`` over columns, for references with dots and other rare forms."""
    return pd.Series([normalize(b, h) for b, h in zip(base, href)], dtype=object)


def host(url: Column) -> Column:
    """Authority: host with port and user, where given."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path of a URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize_expression(base: Column, href: Column) -> Column:
    """``normalize`` for absolute, ``//host``, ``/path`` and ``?query`` references without dot segments, as one expression."""
    bare = F.regexp_extract(href, "^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    return (
        F.when(bare == "", None)
        .when(scheme.isin("http", "https"), bare)
        .when(scheme != "", None)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .when(bare.startswith("?"), F.concat(page, bare))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), bare))
    )


def physical_depth(url: Column) -> Column:
    """Number of path segments that are not empty."""
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def logical_depth(parent_host: Column, url: Column, depth: Column) -> Column:
    """The parent's depth, one more on another host."""
    return depth + F.when(host(url) != parent_host, 1).otherwise(0)


def same_domain(url: Column, domain: str) -> Column:
    """On the domain or a subdomain of it."""
    return (host(url) == domain) | host(url).endswith("." + domain)


def page_kind(url: Column) -> Column:
    """``dynamic`` with a query or a dynamic extension, else ``static``."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]+)", 1)
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    extension = F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))
    return F.when((query != "") | extension.isin(*DYNAMIC), "dynamic").otherwise("static")


def crawl(edges: DataFrame, seeds: list[str], *, max_logical: int = 3, max_physical: int = 3, per_site: int | None = 20, most: int = 1000, domain: str | None = None, content: DataFrame | None = None) -> DataFrame:
    """(url, position, logical, physical): the pages that a first-in-first-out crawl of ``edges`` (src, pos, dst) visits, in order.

    One level of the search is one plan. A level's candidates arrive in the order of their parents, then of their links. Rows that fail a test of
    their own are dropped before the earliest arrival of each page is chosen, as an early arrival may fail where a later one passes;
    then follow the cap per site and the overall cap. Depths count from the seeds' real depths. Failed pages (absent
    from ``content`` (url, ok), or not ok, if that is given) are remembered, not visited, and count for no cap.
    """
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(i, 0, u) for i, u in enumerate(seeds)], "parent long, pos int, url string").withColumn("logical", F.lit(0))
    visited = done = None
    count = 0
    while count < most:
        rows = frontier.withColumn("physical", physical_depth(F.col("url"))).withColumn("site", host(F.col("url")))
        rows = rows.where((F.col("logical") <= max_logical) & (F.col("physical") <= max_physical))
        if domain:
            rows = rows.where(same_domain(F.col("url"), domain))
        if done is not None:
            rows = rows.join(done.select("url"), "url", "left_anti")
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("parent", "pos"))).where("nth = 1").drop("nth")
        if content is not None:
            rows = rows.join(content.select("url", "ok"), "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        else:
            rows = rows.withColumn("ok", F.lit(True))
        failed = rows.where("NOT ok").select("url")
        rows = rows.where("ok")
        if per_site is not None:
            rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("parent", "pos")))
            if visited is not None:
                rows = rows.join(visited.groupBy("site").agg(F.count("*").alias("had")), "site", "left")
            else:
                rows = rows.withColumn("had", F.lit(0))
            rows = rows.where(F.col("nth") + F.coalesce("had", F.lit(0)) <= per_site).drop("nth", "had")
        # a level is at most what is left of the overall cap
        level = rows.orderBy("parent", "pos").limit(most - count).withColumn("position", (F.row_number().over(Window.orderBy("parent", "pos")) + count).cast("long"))
        level = materialize(level.select("url", "position", "logical", "physical", "site"), "crawl-level")
        n = level.count()
        if not n:
            break
        count += n
        visited = level if visited is None else visited.unionByName(level)
        seen = level.select("url").unionByName(failed) if content is not None else level.select("url")
        done = seen if done is None else done.unionByName(seen)
        out = level.join(edges, F.col("url") == F.col("src")).select(F.col("position").alias("parent"), F.col("pos").cast("int").alias("pos"), F.col("dst").alias("url"), logical_depth(F.col("site"), F.col("dst"), F.col("logical")).cast("int").alias("logical"))
        frontier = out
    if visited is None:
        return spark.createDataFrame([], "url string, position long, logical int, physical int")
    return visited.select("url", "position", "logical", "physical").orderBy("position")
