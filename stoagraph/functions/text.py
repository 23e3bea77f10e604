"""Column expressions on texts: words, citations, suffixes, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word character of any script. Java's and RE2's short classes differ on accented letters, this one does not.
W = r"[\p{L}\p{N}_]"
#: The beginning of a word, consuming the character before it.
START = rf"(?:^|[^\p{{L}}\p{{N}}_])"
# A citation in brackets, and a publication or revision date.
CITATION = r"\(([A-Z][a-zA-Z\s&,]+)\s+(\d{4}[a-z]?)\)"
PUBLISHED = r"First published \w+ \d{1,2}, \d{4}"
REVISED = r"last revised \w+ \d{1,2}, \d{4}"


def words(text: Column) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Number of whitespace tokens; 0 for an empty text, null for null."""
    return F.when(text.isNotNull(), F.size(words(text)))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(rf"({W}+)"), F.lit(1))


def head(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def citations(text: Column) -> Column:
    """Array of ``(authors, year)`` in order, repeated ones kept."""
    found = [F.regexp_extract_all(text, F.lit(CITATION), F.lit(k)) for k in (1, 2)]
    return F.zip_with(found[0], found[1], lambda a, y: F.struct(F.trim(a).alias("authors"), y.alias("year")))


def stated_date(text: Column, pattern: str) -> Column:
    """The whole match of a date sentence, null without one."""
    hit = F.regexp_extract(text, pattern, 0)
    return F.when(hit != "", hit)


def typed_date(stated: Column) -> Column:
    """The date in a date sentence."""
    return F.try_to_timestamp(F.regexp_extract(stated, r"(\p{L}+ \d{1,2}, \d{4})", 1), F.lit("MMMM d, yyyy")).cast("date")


def chunks(text: Column, size: int = 512, most: int = 20) -> Column:
    """Consecutive pieces of ``size`` characters, at most ``most``; an empty text has none."""
    n = F.least(F.ceil(F.length(text) / size).cast("int"), F.lit(most))  # (least passes over nulls)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def collapsed(text: Column) -> Column:
    """Runs of whitespace as one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def entry_id(url: Column) -> Column:
    """Last path segment, final slashes removed first."""
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def title_from_id(name: Column) -> Column:
    """An identifier with blanks for hyphens and capital initials."""
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


def ellipsis(text: Column, most: int = 50) -> Column:
    """The text, cut to ``most`` characters and three dots if longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
