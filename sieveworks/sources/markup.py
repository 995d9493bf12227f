"""Markup sources: whole-file text, XML and HTML documents as field projections (JVM-side XPath and patterns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, floor2, price, stem_of_path, strip_tags, unescape, year


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, value): one row per file."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return df.select("path", stem_of_path("path").alias("id"), "value")


def xml(column: str = "value") -> Column:
    """The document without its type declaration, so that no DTD is looked for."""
    return F.regexp_replace(column, r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "")


def text_docs(files: DataFrame) -> DataFrame:
    return files.select("id", unescape("value").alias("content"))


def encyclopedia(files: DataFrame) -> DataFrame:
    """(id, title, content) of article files: title attribute, tags stripped; redirects are skipped."""
    title = unescape(F.regexp_extract("value", r'<article[^>]*\stitle="([^"]*)"', 1))
    return files.where(~F.contains("value", F.lit("<listitem>REDIRECT"))).select("id", title.alias("title"), collapse(unescape(strip_tags("value"))).alias("content"))


def encyclopedia_09(files: DataFrame) -> DataFrame:
    """(id, title, content) of article files with a title element; texts that start with REDIRECT are skipped."""
    title = F.regexp_extract("value", r"(?s)<title>(.*?)</title>", 1)
    body = collapse(unescape(strip_tags("value")))
    return files.select("id", collapse(unescape(title)).alias("title"), body.alias("content")).where(~F.startswith("content", F.lit("REDIRECT")))


def node_texts(x: Column, path: str) -> Column:
    """Trimmed non-empty text nodes under path, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.xpath(x, F.lit(f"{path}//text()")), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != ""), " ")


def node_text(x: Column, tag: str) -> Column:
    return F.trim(F.xpath_string(x, F.lit(f"//{tag}[1]")))


def movies(files: DataFrame) -> DataFrame:
    """(id, title, keywords, plot, actors, rest)."""
    x = xml()
    t = lambda *tags: F.trim(F.concat_ws(" ", *[F.when(node_texts(x, f"(//{g})[1]") != "", node_texts(x, f"(//{g})[1]")) for g in tags]))
    people = ("actors", "composers", "producers", "writers", "directors")
    return files.select("id", t("title").alias("title"), t("genre", "keywords").alias("keywords"), t("plot", "tagline").alias("plot"), t(*people).alias("actors"), t("miscellaneous", "additional_details", "fun_stuff").alias("rest"))


def movies_title_content(files: DataFrame) -> DataFrame:
    return files.select("id", collapse(F.regexp_extract("value", r"(?s)<title>(.*?)</title>", 1)).alias("title"), collapse(strip_tags("value")).alias("content"))


def movies_title_actors_rest(files: DataFrame) -> DataFrame:
    m = movies(files)
    return m.select("id", "title", "actors", F.concat_ws(" ", "keywords", "plot", "rest").alias("rest"))


def movie_ratings(files: DataFrame) -> DataFrame:
    """(id, rating): first word of the rating element, missing 0, best first."""
    r = F.coalesce(F.expr("try_cast(split(trim(xpath_string(_x, '//rating')), ' ')[0] AS DOUBLE)"), F.lit(0.0))
    return files.withColumn("_x", xml()).select("id", r.alias("rating")).orderBy(F.col("rating").desc(), "id")


def books(files: DataFrame) -> DataFrame:
    """(isbn, title, creators, tags, dewey, content): content is the text outside the other fields."""
    x = xml()
    own = ("title", "creators", "tags", "dewey")
    rest = "/book/*[" + " and ".join(f"not(self::{t})" for t in own) + "]"
    return files.select(F.col("id").alias("isbn"), *(node_texts(x, f"(//{t})[1]").alias(t) for t in own), node_texts(x, rest).alias("content"))


def book_tags(files: DataFrame) -> DataFrame:
    """(isbn, tags): every tag repeated as often as it was given."""
    x = xml()
    names, counts = F.xpath(x, F.lit("//tag/text()")), F.xpath(x, F.lit("//tag/@count"))
    rep = F.flatten(F.zip_with(names, counts, lambda n, c: F.array_repeat(F.trim(n), F.coalesce(c.cast("int"), F.lit(1)))))
    return files.select(F.col("id").alias("isbn"), F.array_join(rep, " ").alias("tags"))


def book_features(files: DataFrame) -> DataFrame:
    """Thirteen features per book; missing values are '0'."""
    x = xml()
    first = lambda t: F.when(node_text(x, t) == "", "0").otherwise(node_text(x, t))
    n = lambda t: F.xpath_int(x, F.lit(f"count(//{t})")).alias(f"n_{t.lower()}")
    ratings = F.transform(F.xpath(x, F.lit("//rating/text()")), lambda r: r.cast("double"))
    mean = F.when(F.size(ratings) > 0, floor2(F.aggregate(ratings, F.lit(0.0), lambda a, r: a + r) / F.size(ratings))).otherwise(0.0)
    return files.select(
        F.col("id").alias("isbn"), first("binding").alias("binding"), price(first("listprice")).alias("price"), year(first("publicationdate")).alias("year"), F.substring_index(first("dewey"), ".", 1).alias("dewey"), first("numberofpages").alias("pages"),
        *(n(t) for t in ("image", "review", "editorialreview", "creator", "similarproduct", "browseNode", "rating")), mean.cast("double").alias("mean_rating"),
    )


def topics(files: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(qid, text) of topic files: the chosen child labels joined; empty texts are dropped."""
    topic = F.explode(F.expr(r"regexp_extract_all(value, r'(?s)(<topic\b.*?</topic>)', 1)")).alias("t")
    text = F.concat_ws(" ", *[F.when(node_texts(F.col("t"), f"/topic/{g}") != "", node_texts(F.col("t"), f"/topic/{g}")) for g in labels])
    return files.select(topic).select(F.xpath_int("t", F.lit("/topic/@id")).alias("qid"), text.alias("text")).where("text <> ''")


def html_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``title`` and ``text``: title element, body text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return pages.withColumns({"title": collapse(unescape(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))), "text": collapse(unescape(strip_tags(bare)))})
