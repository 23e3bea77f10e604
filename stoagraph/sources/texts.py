"""Readers of bibliographies, front matter, search indexes and entry lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One field of a bibliography entry, with braces (two levels), quotes, or a bare word or number.
FIELD = r"""(?m)^\s*([A-Za-z_-]+)\s*=\s*(\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|"[^"]*"|\w+)"""
SEARCH = "title string, section string, text string, href string, crumbs array<string>"
ENTRIES = "id string, title string, url string"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def bibliography(texts: DataFrame, text: str = "value") -> DataFrame:
    """``(type, key, fields)`` of BibTeX texts; field names in lower case, outer braces and quotes removed.

    Entries without a key are left out; a field given twice keeps its last value; repeated keys stay.
    """
    entry = F.explode(F.split(F.col(text), r"(?m)^(?=@)"))
    one = texts.select(entry.alias("e")).select("e", F.lower(F.regexp_extract("e", r"^@(\w+)\s*\{", 1)).alias("type"), F.trim(F.regexp_extract("e", r"^@\w+\s*\{\s*([^,\s]+)\s*,", 1)).alias("key"))
    names, values = (F.regexp_extract_all("e", F.lit(FIELD), F.lit(g)) for g in (1, 2))
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, r'^[{"]|[}"]$', ""), r"\s+", " ")
    pairs = F.zip_with(F.transform(names, F.lower), F.transform(values, bare), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    # read from the end, so that of a name given twice the last value stays
    none = F.array().cast("array<struct<k:string,v:string>>")
    kept = F.aggregate(F.reverse(pairs), none, lambda a, p: F.when(F.exists(a, lambda q: q["k"] == p["k"]), a).otherwise(F.concat(a, F.array(p))))
    return one.filter((F.col("key") != "") & (F.col("type") != "")).select("type", "key", F.map_from_entries(kept).alias("fields"))


def bibliography_view(entries: DataFrame) -> DataFrame:
    """``(key, type, title, authors, year)``: authors split at "and", the year as a number."""
    f = F.col("fields")
    year = F.regexp_extract(F.coalesce(f["year"], f["date"]), r"(\d{4})", 1)
    return entries.select("key", "type", f["title"].alias("title"), F.split(f["author"], r"\s+and\s+").alias("authors"), F.when(year != "", year.cast("int")).alias("year"))


def front_matter(texts: DataFrame, text: str = "value") -> DataFrame:
    """``(path, title, author, date, date_on)`` from the block between the first two lines of three dashes.

    Only plain keys at the left edge are read; nested ones and missing ones are null.
    """
    block = F.regexp_extract(F.col(text), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)

    def value(key: str) -> Column:
        hit = F.regexp_extract(F.col("block"), rf"(?m)^{key}:[ \t]*(\S.*?)[ \t]*$", 1)
        return F.when(hit != "", F.regexp_replace(hit, "^[\"']|[\"']$", ""))

    out = texts.select("path", block.alias("block")).select("path", value("title").alias("title"), value("author").alias("author"), value("date").alias("date"))
    return out.withColumn("date_on", F.try_to_timestamp("date", F.lit("MM.dd.yyyy")).cast("date"))


def search_index(spark: SparkSession, path: str) -> DataFrame:
    """A search index: one JSON array of documents."""
    return spark.read.schema(SEARCH).json(path, multiLine=True)


def listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("listing string, items array<string>").json(path, multiLine=True)


def cached_entries(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index of entries, or None if there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(ENTRIES).json(path)
