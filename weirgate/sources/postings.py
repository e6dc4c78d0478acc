"""Sources of postings and profiles, and sinks. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOARD_JSON = "jobs array<struct<title:string,absolute_url:string,content:string,location:struct<name:string>>>"
ARRAY_JSON = "array<struct<text:string,applyUrl:string,hostedUrl:string,descriptionPlain:string,categories:struct<location:string>>>"


def url_list(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """One posting per line that is neither blank nor a # comment; with the columns to keep."""
    url = F.trim(F.regexp_replace(F.col(column), "\r$", ""))
    return lines.select(*keep, url.alias("url"), F.lit("url-list").alias("source")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_list(spark.read.text(path))


def csv_postings(rows: DataFrame) -> DataFrame:
    """Postings of a table with headers in any case; `url` is mandatory, rows without one are dropped, a description is not read."""
    named = {c.strip().lower(): c for c in rows.columns}
    if "url" not in named:
        raise ValueError("the file needs a url column")
    get = lambda c: F.trim(F.coalesce(F.col(f"`{named[c]}`"), F.lit(""))) if c in named else F.lit("")
    return rows.select(*(get(c).alias(c) for c in ("title", "company", "location", "url")), F.lit("csv").alias("source")).where("url != ''")


def read_csv_postings(spark: SparkSession, path: str) -> DataFrame:
    return csv_postings(spark.read.csv(path, header=True))


def board_jobs(documents: DataFrame, column: str = "json") -> DataFrame:
    """A board's object of jobs; those without an address are dropped."""
    jobs = documents.select(F.explode(F.from_json(column, BOARD_JSON)["jobs"]).alias("j"))
    return jobs.where(F.coalesce("j.absolute_url", F.lit("")) != "").select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in (("j.title", "title"), ("j.location.name", "location"), ("j.absolute_url", "url"), ("j.content", "description"))))


def board_array(documents: DataFrame, column: str = "json") -> DataFrame:
    """A board's array of jobs; the address to apply at goes before the one that shows the job."""
    jobs = documents.select(F.explode(F.from_json(column, ARRAY_JSON)).alias("j"))
    url = F.coalesce(F.nullif("j.applyUrl", F.lit("")), F.nullif("j.hostedUrl", F.lit("")))
    return jobs.where(url.isNotNull()).select(F.coalesce("j.text", F.lit("")).alias("title"), F.coalesce("j.categories.location", F.lit("")).alias("location"), url.alias("url"), F.coalesce("j.descriptionPlain", F.lit("")).alias("description"))


def profile_map(json: Column) -> Column:
    """A profile's keys and values; blanks are dropped, values stripped. Null if it is no object."""
    got = F.from_json(json, "map<string,string>")
    return F.transform_values(F.map_filter(got, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != ""), lambda k, v: F.trim(v))


def unknown_keys(profile: Column, known: list[str]) -> Column:
    return F.array_sort(F.array_except(F.map_keys(profile), F.array(*map(F.lit, known))))


def single_url(spark: SparkSession, url: str) -> DataFrame:
    """One posting of a url given by hand."""
    return spark.createDataFrame([(url.strip(), "url")], "url string, source string")


def newest(files: DataFrame, hint: str, n: int, name: str = "path", when: str = "modificationTime", tie: str = "path") -> DataFrame:
    """The n newest files whose names hold a hint: a distributed top-n."""
    return files.where(F.contains(F.lower(name), F.lit(hint))).orderBy(F.col(when).desc(), tie).limit(n)


def recent_files(spark: SparkSession, path: str, glob: str = "*.pdf", hint: str = "resume", n: int = 12) -> DataFrame:
    """The newest files whose names hold a hint; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return newest(files.select("path", "modificationTime"), hint, n)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def html_posting(html: Column) -> Column:
    """struct(title, meta, body) of a saved page: a heading that is not empty overrides the title."""
    from weirgate.functions.text import clean_spaces, first_non_empty, unescape

    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    plain = lambda x: clean_spaces(unescape(F.regexp_replace(x, "<[^>]+>", " ")))
    title = plain(F.regexp_extract(bare, r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = plain(F.regexp_extract(bare, r"(?is)<(h[12])\b[^>]*>(.*?)</\1>", 2))
    def meta(attribute: str, name: str) -> Column:
        """The content of a meta tag, its attributes in any order and with either quotes."""
        tag = F.regexp_extract(bare, rf"""(?is)<meta\b(?=[^>]*\b{attribute}\s*=\s*["']?{name}["'\s/>])[^>]*>""", 0)
        quoted = [F.regexp_extract(tag, rf"(?is)\bcontent\s*=\s*{q}([^{q}]*){q}", 1) for q in "\"'"]
        return clean_spaces(unescape(first_non_empty(*quoted)))

    a, b = meta("name", "description"), meta("property", "og:description")
    return F.struct(first_non_empty(head, title).alias("title"), F.when(F.length(a) >= F.length(b), a).otherwise(b).alias("meta"), plain(bare).alias("body"))


def write_history_csv(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").csv(path, header=True)


def report_json(applications: DataFrame, by: list[str], fields: list[str], order: str) -> DataFrame:
    """One JSON object per application, its fields in order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return applications.groupBy(*by).agg(rows.alias("fields")).select(*by, F.to_json(F.struct(*by, "fields")).alias("report"))
