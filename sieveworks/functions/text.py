"""Text analysis and scalar expressions (all JVM-side column expressions)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five XML entities.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    t = F.split(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(t, lambda x: (x != "") & ~x.isin(*stop) if stop else x != "")


def biwords(text: Column | str) -> Column:
    """Adjacent token pairs joined by a blank; fewer than two tokens give none."""
    t = tokens(text)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(pairs)


def analyse(text: Column | str, kind: str = "unigram") -> Column:
    return biwords(text) if kind == "biword" else tokens(text)


def normalise_query(text: Column | str) -> Column:
    """Non-alphanumerics to blanks, collapsed, lower case, so that AND and OR are plain words."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", " "))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"<[^>]*>", " ")


def unescape(text: Column | str) -> Column:
    """The five XML entities; the ampersand last, so that nothing is unescaped twice."""
    out = _c(text)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def clean_query(text: Column | str) -> Column:
    """Carriage returns removed, commas to blanks, apostrophes to back quotes."""
    return F.translate(F.replace(_c(text), F.lit("\r"), F.lit("")), ",'", " `")


def stem_of_path(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)\.[^./]+$", 1)


def before_last(text: Column | str, sep: str) -> Column:
    c = _c(text)
    last = F.substring_index(c, sep, -1)
    return F.when(F.contains(c, F.lit(sep)), F.left(c, F.length(c) - F.length(last) - len(sep))).otherwise(c)


def after_last(text: Column | str, sep: str) -> Column:
    return F.substring_index(_c(text), sep, -1)


def dewey_class(code: Column | str) -> Column:
    return F.substring_index(_c(code), ".", 1)


def price(text: Column | str) -> Column:
    return F.translate(_c(text), "$,", "").cast("double")


def year(text: Column | str) -> Column:
    return F.substring_index(_c(text), "-", 1)


def isbn_path(prefix: str, isbn: Column | str, weight: Column | str) -> Column:
    return F.format_string(f"{prefix}/%s/%s.xml,%s", F.right(_c(isbn), F.lit(3)), _c(isbn), _c(weight).cast("string"))


def json_sum(text: Column | str) -> Column:
    """Sum of the numeric values of a JSON object."""
    return F.aggregate(F.map_values(F.from_json(_c(text), "map<string,double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def floor2(x: Column | str) -> Column:
    return F.floor(_c(x) * 100) / 100


def add_matrices(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def all_keywords(text: Column | str, keywords: Column) -> Column:
    """Every keyword is a white-space token of the text, case ignored."""
    words = F.split(F.lower(_c(text)), r"\s+")
    return F.forall(keywords, lambda k: F.array_contains(words, F.lower(k)))


def keyword_subsets(keywords: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(keywords) + 1) for c in itertools.combinations(keywords, n)]


def min_over(values: Column) -> Column:
    return F.array_min(values)


def product_over(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
