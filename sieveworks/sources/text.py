"""Line-oriented sources: path lists, qrels, query logs, dictionaries, learning-to-rank files, repaired CSV.

Every reader is a projection of ``spark.read.text``; malformed lines are dropped as stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import before_last, stem_of_path


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_path_list(df: DataFrame) -> DataFrame:
    """(path, weight, title) of lines 'path,count[,title]'; lines without a comma or a number are dropped."""
    f = F.split("value", ",", 3)
    num = F.expr("try_cast(trim(split(value, ',', 3)[1]) AS DOUBLE)")
    return df.where(F.contains("value", F.lit(","))).select(F.trim(f[0]).alias("path"), num.alias("weight"), F.coalesce(F.trim(F.get(f, 2)), F.lit("")).alias("title")).where("weight IS NOT NULL")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_path_list(lines(spark, path))


def path_list_by_stem(spark: SparkSession, path: str) -> DataFrame:
    return path_list(spark, path).withColumn("id", stem_of_path("path"))


def parse_popularity(df: DataFrame) -> DataFrame:
    """(id, pop) of lines 'folder/id.xml,count[,...]' (or .txt); others are dropped."""
    cells = F.split("value", ",")
    path = cells[0]
    parts = F.split(F.substring_index(path, "/", -1), "[.]")
    named = (F.instr(path, "/") > 0) & ~F.startswith(path, F.lit("/")) | (F.size(F.split(path, "/")) > 2)
    fine = named & (F.size(cells) >= 2) & (F.size(parts) == 2) & parts[1].isin("xml", "txt") & (parts[0] != "")
    return df.where(fine).select(parts[0].alias("id"), F.trim(cells[1]).try_cast("double").alias("pop")).where("pop IS NOT NULL")


def popularity_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_popularity(lines(spark, path))


def parse_qrels(df: DataFrame) -> DataFrame:
    """(qid, doc_id, rel) of lines 'qid Q0 doc rel' (or 0 for Q0); rel 0 and repetitions are dropped."""
    cells = F.split(F.trim("value"), "[ \t]+")
    whole = df.where((F.size(cells) >= 4) & cells[1].isin("Q0", "0"))
    return whole.select(cells[0].try_cast("int").alias("qid"), cells[2].alias("doc_id"), cells[3].try_cast("int").alias("rel")).where("qid IS NOT NULL AND rel <> 0").dropDuplicates()


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(lines(spark, path))


def parse_queries(df: DataFrame) -> DataFrame:
    """(qid, text) of lines 'text qid'; commas and quotes in the text are removed."""
    p = r"^(.*) (\d+)\s*$"
    return df.select(F.regexp_extract("value", p, 2).alias("q"), F.translate(F.regexp_extract("value", p, 1), ',"', "").alias("text")).where("q <> ''").select(F.col("q").cast("int").alias("qid"), "text")


def judged_queries(queries: DataFrame, judged: DataFrame) -> DataFrame:
    return queries.join(judged.select("qid"), "qid", "left_semi")


def query_log(spark: SparkSession, path: str, judged: DataFrame) -> DataFrame:
    return judged_queries(parse_queries(lines(spark, path)), judged)


def wide_query_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a headed TSV with six columns or more, a number first and a sixth that isn't NULL; columns c0, c1, ..."""
    f = F.split("value", "\t")
    body = spark.read.option("header", "false").text(path).where((F.size(f) >= 6) & (f[5] != "NULL"))
    return body.where(F.expr("try_cast(split(value, '\t')[0] AS LONG) IS NOT NULL")).select(*[f[i].alias(f"c{i}") for i in range(6)], F.lit(1).alias("rel"))


def frequency_queries(spark: SparkSession, path: str, judged: DataFrame) -> DataFrame:
    """(qid, text, freq) of a TSV 'qid text freq', judged queries only."""
    return judged_queries(spark.read.csv(path, sep="\t", schema="qid int, text string, freq int", mode="DROPMALFORMED"), judged)


def dewey(spark: SparkSession, path: str) -> DataFrame:
    """(code, category), separated by three blanks."""
    f = F.split("value", "   ", 2)
    return lines(spark, path).where(F.contains("value", F.lit("   "))).select(F.trim(f[0]).alias("code"), F.trim(f[1]).alias("category"))


def id_pairs(spark: SparkSession, path: str, a: str = "isbn", b: str = "ltid") -> DataFrame:
    return spark.read.csv(path, schema=f"{a} string, {b} string", mode="DROPMALFORMED")


def inverse_pairs(pairs: DataFrame, a: str = "isbn", b: str = "ltid") -> DataFrame:
    return pairs.groupBy(b).agg(F.array_sort(F.collect_set(a)).alias(f"{a}s"))


def ordered_ids(spark: SparkSession, path: str) -> DataFrame:
    """(rank, id) of a path list, heaviest first; equal weights by path."""
    from ..operators.subset import global_rank

    return global_rank(path_list_by_stem(spark, path), "weight", "path", "rank").select("rank", "id")


def parse_mslr(df: DataFrame) -> DataFrame:
    """(rel, qid, bm25, url_id, clicks) of lines 'rel qid:n 1:v ... 136:v'."""
    f = F.split(F.trim("value"), " +")
    v = lambda i: F.substring_index(f[i + 1], ":", -1)
    return df.where(F.size(f) >= 138).select(f[0].cast("int").alias("rel"), F.substring_index(f[1], ":", -1).cast("int").alias("qid"), v(106).cast("double").alias("bm25"), F.concat_ws("|", v(126), v(127), v(128), v(129)).alias("url_id"), v(135).cast("double").cast("int").alias("clicks"))


def mslr(spark: SparkSession, path: str) -> DataFrame:
    return parse_mslr(lines(spark, path))


def token_popularities(spark: SparkSession, path: str) -> DataFrame:
    """(term, mean_pop, min_pop): the last two fields are mean and minimum; a repeated term has its smallest minimum and largest mean."""
    f = F.split("value", ",")
    n = F.size(f)
    row = lines(spark, path).where(n >= 3).select(F.array_join(F.slice(f, 1, n - 2), ",").alias("term"), F.expr("try_cast(split(value, ',')[size(split(value, ',')) - 2] AS DOUBLE)").alias("m"), F.expr("try_cast(split(value, ',')[size(split(value, ',')) - 1] AS DOUBLE)").alias("lo"))
    return row.where("m IS NOT NULL AND lo IS NOT NULL").groupBy("term").agg(F.max("m").alias("mean_pop"), F.min("lo").alias("min_pop"))


def query_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, freq, wiki_ids) of log blocks: '# n ---', '# wikiID : x', '# frequency : n', '# entityID : ..' and the text in the next line.

    Blocks are records of their own (split at the block mark), so that blocks parse in parallel.
    """
    raw = spark.read.text(path, wholetext=True)
    block = raw.select(F.explode(F.expr(r"regexp_extract_all(value, r'(?s)# (\d+ -+.*?)(?=# \d+ --|\z)', 1)")).alias("b"))
    freq = F.aggregate(F.expr(r"regexp_extract_all(b, r'# frequency : (\d+)', 1)"), F.lit(0), lambda s, x: s + x.cast("int"))
    return block.select(F.regexp_extract("b", r"^(\d+)", 1).cast("int").alias("id"), F.trim(F.regexp_extract("b", r"# entityID :[^\n]*\n([^\n]*)", 1)).alias("text"), freq.alias("freq"), F.expr(r"transform(regexp_extract_all(b, r'# wikiID : ([^\n]+)', 1), x -> trim(x))").alias("wiki_ids"))


def qid_lookup(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """queries (text) with qid by exact text, else by text with blanks around slashes removed; unknown texts are dropped."""
    norm = lambda c: F.regexp_replace(c, " ?/ ?", " ")
    exact = dictionary.select("text", F.col("qid").alias("_a")).dropDuplicates(["text"])
    loose = dictionary.select(norm("text").alias("_n"), F.col("qid").alias("_b")).dropDuplicates(["_n"])
    out = queries.join(exact, "text", "left").withColumn("_n", norm("text")).join(loose, "_n", "left")
    return out.withColumn("qid", F.coalesce("_a", "_b")).where("qid IS NOT NULL").drop("_a", "_b", "_n")


def parse_title_list(df: DataFrame) -> DataFrame:
    """(path, title) of lines '../(inex_13/....xml):(title)'."""
    p = r"(inex_13/.*\.xml):(.*)$"
    return df.select(F.regexp_extract("value", p, 1).alias("path"), F.trim(F.regexp_extract("value", p, 2)).alias("title")).where("path <> ''")


def parse_page_views(df: DataFrame, project: str = "en") -> DataFrame:
    """(title, count) of lines 'project title count bytes'; underscores are blanks."""
    p = r"^(\S+) (\S+) (\d+) (\d+)$"
    g = lambda i: F.regexp_extract("value", p, i)
    return df.where(g(1) == project).select(F.replace(g(2), F.lit("_"), F.lit(" ")).alias("title"), g(3).cast("long").alias("count"))


def parse_ratings(df: DataFrame) -> DataFrame:
    """(isbn, rating, ratings): 'user,isbn,rate,ts' averaged per isbn."""
    f = F.split("value", ",")
    return df.where(F.size(f) >= 3).select(f[1].alias("isbn"), F.expr("try_cast(split(value, ',')[2] AS DOUBLE)").alias("r")).where("r IS NOT NULL").groupBy("isbn").agg(F.avg("r").alias("rating"), F.count("*").alias("ratings"))


def parse_sales(df: DataFrame) -> DataFrame:
    """(asin, title, rank) of single-quoted JSON lines; rank reversed as 15000000 - rank, missing ones -1."""
    j = F.from_json("value", "asin string, title string, salesRank map<string,long>", {"allowSingleQuotes": "true"})
    r = F.element_at(F.map_values("j.salesRank"), 1)
    return df.select(j.alias("j")).select("j.asin", "j.title", F.when(r.isNull(), -1).otherwise(15000000 - r).alias("rank"))


def repair_csv(df: DataFrame, columns: int = 37) -> DataFrame:
    """Fields array per line: surplus leading fields belong to the text in front; shorter lines are dropped."""
    f = F.split("value", ",")
    extra = F.size(f) - columns
    return df.where(extra >= 0).select(F.concat(F.array(F.array_join(F.slice(f, 1, extra + 1), " ")), F.slice(f, extra + 2, columns)).alias("fields"))


def parse_title_votes(df: DataFrame) -> DataFrame:
    """(title, votes) of 'title;votes;rank', and again without the marks (VG), (V) and (TV)."""
    f = F.split("value", ";")
    row = df.where(F.size(f) == 3).select(f[0].alias("t"), F.expr("try_cast(split(value, ';')[1] AS INT)").alias("votes"))
    both = F.array_distinct(F.array("t", F.trim(F.regexp_replace("t", r" ?\((VG|V|TV)\)", ""))))
    return row.where("votes IS NOT NULL").select(F.explode(both).alias("title"), "votes").groupBy("title").agg(F.max("votes").alias("votes"))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def daily_views(df: DataFrame, column: str = "value") -> DataFrame:
    """(total) of the daily_views object in a JSON answer."""
    j = F.from_json(column, "daily_views map<string,long>")
    return df.select(F.aggregate(F.map_values(j["daily_views"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def html_field(column: str, pattern: str):
    return F.regexp_extract(column, pattern, 1)


def without_last_word(column: str):
    return before_last(column, " ")
