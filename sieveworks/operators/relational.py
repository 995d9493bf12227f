"""Relational composition used throughout: bridges, decompositions, semi and anti joins, fallbacks, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bridge(left: DataFrame, link: DataFrame, right: DataFrame, left_key: tuple[str, str], right_key: tuple[str, str], how: str = "inner") -> DataFrame:
    """left - link - right through a many-to-many table; keys are (column of the entity, column of the link)."""
    out = left.join(link, left[left_key[0]] == link[left_key[1]], how)
    return out.join(right, link[right_key[1]] == right[right_key[0]], how)


def decompose(df: DataFrame, key: str, parts: dict[str, Column]) -> dict[str, DataFrame]:
    """Horizontal parts by predicate, and ``other`` with the rows whose key is in none of them."""
    out = {name: df.where(p) for name, p in parts.items()}
    taken = reduce(DataFrame.union, [p.select(key) for p in out.values()]).distinct()
    return out | {"other": df.join(taken, key, "left_anti")}


def completeness(df: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row: the parts' counts together less the whole's."""
    counts = [p.agg(F.count("*").alias("n")) for p in parts.values()]
    total = reduce(DataFrame.union, counts).agg(F.sum("n").alias("n_parts"))
    return total.crossJoin(df.agg(F.count("*").alias("n_all"))).select("n_parts", "n_all", (F.col("n_parts") - F.col("n_all")).alias("surplus"))


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL's NOT IN: nothing if the other side has a null, and no rows with a null of their own unless it is empty."""
    spark = df.sparkSession
    df.createOrReplaceTempView("_not_in_left")
    other.createOrReplaceTempView("_not_in_right")
    return spark.sql(f"SELECT * FROM _not_in_left WHERE `{column}` NOT IN (SELECT `{other_column}` FROM _not_in_right)")


def blocks(df: DataFrame, column: str, rows: str, block: int = 4096) -> DataFrame:
    """(the other columns, rows): the column's values, nulls too, in arrays of about ``block`` for each combination of the others."""
    by = [c for c in df.columns if c != column]
    n = df.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("_n"))
    dealt = df.join(n, by).withColumn("_block", F.pmod(F.xxhash64(column), F.col("_n")))
    return dealt.groupBy(*by, "_block").agg(F.collect_list(F.struct(column)).getField(column).alias(rows)).drop("_block")


def block_pairs(both: DataFrame, left: str, right: str, key: str, value: str) -> DataFrame:
    """(the other columns, key, value): each row's two arrays crossed.

    Rows are dealt over all cores and expanded where they land: no pair is shuffled, and a group of any size is shared by
    as many tasks as it has pairs of blocks. Generated code keeps all rows it makes of one input row before it hands on the
    first. ``transform`` has no generated code, which keeps the two explodes apart: at most one array's length is held, not the product.
    """
    rest = [c for c in both.columns if c not in (left, right)]
    both = both.repartition(8 * both.sparkSession.sparkContext.defaultParallelism)
    return both.select(*rest, F.explode(F.transform(left, lambda x: x)).alias(key), right).select(*rest, key, F.explode(right).alias(value))


def cascade_match(probe: DataFrame, build: DataFrame, key: str, title: str, value: str) -> DataFrame:
    """(key, value, stage): exact title match, else the build title's part before ':' or '(' equals the probe, else the probe's part does.

    A key's stage is found from the distinct titles; only then are pairs made, and only those of keys and values
    with several titles can repeat and are compared with each other.
    """
    cut = lambda c: F.trim(F.regexp_extract(c, r"^([^:(]*)", 1))
    p = probe.select(F.col(key), F.lower(title).alias("_t")).where("_t IS NOT NULL").distinct()
    b = build.select(F.col(value), F.lower(title).alias("_b")).where("_b IS NOT NULL").distinct()
    whole, parts = b.select(F.col("_b").alias("_x")).distinct(), b.select(cut("_b").alias("_x")).distinct()
    titles = p.select("_t").distinct().withColumn("_c", cut("_t"))
    for name, column, known in (("_1", "_t", whole), ("_2", "_t", parts), ("_3", "_c", parts)):
        titles = titles.join(known.select(F.col("_x").alias(column), F.lit(True).alias(name)), column, "left")
    stage = F.when(F.col("_1"), 1).when(F.col("_2"), 2).when(F.col("_3"), 3)
    found = titles.select("_t", stage.alias("stage"), F.when(stage == 3, F.col("_c")).otherwise(F.col("_t")).alias("_x"), (stage > 1).alias("_cut")).where("stage IS NOT NULL")
    # a key takes part with its first stage; numbers of titles tell which pairs can come twice
    per_key, count = Window.partitionBy(key), F.count("*")
    left = p.join(found, "_t").select(key, "stage", "_x", "_cut").distinct().withColumn("_first", F.min("stage").over(per_key)).where("stage = _first")
    left = left.withColumn("_many", count.over(per_key) > 1).drop("_first")
    right = b.select(value, F.explode(F.array(F.struct(F.lit(False).alias("_cut"), F.col("_b").alias("_x")), F.struct(F.lit(True).alias("_cut"), cut("_b").alias("_x")))).alias("_s"))
    right = right.select(value, "_s.*").distinct().withColumn("_several", count.over(Window.partitionBy(value, "_cut")) > 1)
    left, right = blocks(left.select("_cut", "_x", "stage", "_many", key), key, "_left"), blocks(right, value, "_right")
    both = left.join(right, ["_cut", "_x"])
    rows = lambda which: block_pairs(both.where(which).select("stage", "_left", "_right"), "_left", "_right", key, value).select(key, value, "stage")
    return rows("NOT (_many AND _several)").unionByName(rows("_many AND _several").distinct())


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def conditional_report(df: DataFrame, bad: Column, measures: list[str], weight: str) -> DataFrame:
    """Weighted means of each measure over all, bad and other rows."""
    w = F.col(weight)
    mean = lambda m, c: F.round(F.sum(F.when(c, F.col(m) * w)) / F.sum(F.when(c, w)), 6)
    cols = [mean(m, c).alias(f"{m}_{n}") for m in measures for n, c in (("all", F.lit(True)), ("bad", bad), ("good", ~bad))]
    return df.agg(*cols)


def title_views(titles: DataFrame, views: DataFrame) -> DataFrame:
    """(path, views): page views summed over equal titles, unmatched paths 0."""
    return titles.join(views, "title", "left").groupBy("path").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("views"))


def tuple_tree(ids: DataFrame, entity: DataFrame, key: str, legs: list[tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """The entities with the given ids, left-joined through each (bridge, bridge column, dimension, dimension key)."""
    out = entity.join(ids, key, "left_semi")
    for link, dim_fk, dim, dim_key in legs:
        out = out.join(link, key, "left").join(dim.withColumnRenamed(dim_key, dim_fk), dim_fk, "left")
    return out


def relation_counts(ids: DataFrame, legs: list[tuple[DataFrame, str]]) -> DataFrame:
    """(qid, n): joined tuples of each query's ids through all bridges; ids: (qid, id)."""
    out = ids
    for link, key in legs:
        per = link.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("_n"))
        out = out.join(per, "id").withColumn("_p", F.col("_n") * (F.col("_p") if "_p" in out.columns else F.lit(1))).drop("_n")
    return out.groupBy("qid").agg(F.sum("_p").alias("n"))


def hard_queries(df: DataFrame, text: str, name: str) -> DataFrame:
    """Rows whose query text, without carriage returns, differs from the lower-case name."""
    return df.where(F.replace(F.col(text), F.lit("\r"), F.lit("")) != F.lower(name))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def running_first(df: DataFrame, part: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(part).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", (F.col("previous").isNull() | (F.col("previous") != F.col(value))).cast("int"))


def unique_columns(df: DataFrame) -> DataFrame:
    """df without columns whose values equal an earlier column's in every row; one aggregation over all columns."""
    numbered = df.withColumn("_n", F.monotonically_increasing_id())
    sums = numbered.agg(*[F.sum(F.xxhash64(F.col(c).cast("string"), "_n").cast("decimal(38,0)")).alias(c) for c in df.columns]).first()
    kept: dict = {}
    for c in df.columns:
        kept.setdefault(sums[c], c)
    return df.select(*kept.values())


def remove_keyword(queries: DataFrame, text: str, pattern: str) -> DataFrame:
    """The pattern's first match in the lower-case text goes to ``keyword``, the text loses it; other queries are dropped."""
    word = F.regexp_extract(F.lower(text), f"({pattern})", 1)
    out = queries.withColumn("keyword", word).where("keyword <> ''")
    return out.withColumn(text, F.trim(F.regexp_replace(F.replace(F.lower(text), F.col("keyword"), F.lit("")), r"\s+", " ")))


def wide(df: DataFrame, key: str, column: str, value: str, values: list) -> DataFrame:
    """One row per key, one column per listed value."""
    return df.groupBy(key).pivot(column, values).agg(F.first(value))
