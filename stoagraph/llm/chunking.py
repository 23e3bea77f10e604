"""Cutting long texts into overlapping pieces at natural boundaries, by one regular expression and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section_heads(lines: Column, sections: Column) -> Column:
    """Array of ``(no, line)``: the headings found going through ``sections`` in order, both counted from 1.

    The heading line of an entry is the first line equal to it after the heading line found last. Null entries and
    entries without a line are passed over; null ``sections`` or lines give an empty array.
    """

    # only lines that are an entry at all are gone through again for every entry
    candidates = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("at"))), lambda c: F.array_contains(sections, c["line"]))

    def step(acc: Column, entry: Column) -> Column:
        found = F.array_min(F.transform(F.filter(acc["todo"], lambda c: (c["at"] > acc["last"]) & (c["line"] == entry)), lambda c: c["at"]))
        no = acc["n"] + 1
        heads = F.when(found.isNotNull(), F.concat(acc["heads"], F.array(F.struct(no.alias("no"), found.alias("line"))))).otherwise(acc["heads"])
        return F.struct(F.coalesce(found, acc["last"]).alias("last"), no.alias("n"), heads.alias("heads"), acc["todo"].alias("todo"))

    none = F.array().cast("array<struct<no:int,line:int>>")
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("n"), none.alias("heads"), candidates.alias("todo"))
    return F.coalesce(F.aggregate(sections, start, step)["heads"], none)


def with_sections(pages: DataFrame, page_id: str, text: str, sections: str) -> DataFrame:
    """One row ``(page_id, section_no, section_text)`` per section; what stands before the first heading is section 0.

    Pages with null text give no rows; every character but the line breaks between sections is in exactly one row.
    """
    lines = F.split(F.col("text"), "\n", -1)
    base = pages.select(F.col(page_id).alias("page_id"), F.col(text).alias("text"), F.col(sections).alias("sections")).filter(F.col("text").isNotNull())
    found = base.select("page_id", lines.alias("lines"), "sections").withColumn("heads", section_heads(F.col("lines"), F.col("sections")))
    lead = F.array(F.struct(F.lit(0).alias("no"), F.lit(1).alias("line")))
    starts = F.when((F.size("heads") > 0) & (F.col("heads")[0]["line"] == 1), F.col("heads")).otherwise(F.concat(lead, F.col("heads")))
    ends = F.concat(F.transform(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), lambda s: s["line"]), F.array(F.size("lines") + 1))
    pieces = F.zip_with("starts", ends, lambda s, e: F.struct(s["no"].alias("no"), F.array_join(F.slice(F.col("lines"), s["line"], e - s["line"]), "\n").alias("body")))
    return (
        found.withColumn("starts", starts)
        .select("page_id", F.explode(pieces).alias("s"))
        .select("page_id", F.col("s.no").alias("section_no"), F.col("s.body").alias("section_text"))
    )


def boundary_pattern(size: int) -> str:
    """Alternatives by strength of the boundary, each at most ``size`` characters.

    The rest of the text; lines; sentences; then the same with less than a third of the size; words; characters.
    """
    least = max(1, size // 3)
    sentence = r"[.!?…]{1,3}[\"”’»)\]]{0,3}\s"
    far, near = max(least, size - 8), max(1, least - 1)
    return (
        rf"(?s).{{1,{size}}}\z"
        rf"|.{{{least},{size - 1}}}\n"
        rf"|.{{{least},{far}}}{sentence}"
        rf"|.{{{0},{near}}}\n"
        rf"|.{{{0},{near}}}{sentence}"
        rf"|.{{{least},{size - 1}}}\s"
        rf"|.{{1,{size}}}"
    )


def cut_cores(text: Column, limit: int, overlap: int) -> Column:
    """Array of consecutive cores that make up the text; a text within the limit is one core."""
    cores = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(cores)


def cut_pieces(sections: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``(page_id, section_no, piece_no, start, n_pieces, piece)``: pieces of at most ``limit`` characters.

    A piece is a core of at most ``limit - overlap`` characters preceded by the ``overlap`` characters before it
    (fewer if the section has fewer). ``start`` is the core's offset in its section. Empty sections give one empty piece.
    """
    if not 0 <= overlap < limit - 16:
        raise ValueError("the overlap must leave room for a core")
    cores = sections.withColumn("cores", cut_cores(F.col("section_text"), limit, overlap)).withColumn("n_pieces", F.size("cores")).drop("section_text")
    # every core with its offset and the characters before it, carried along: no piece goes back to the whole text
    ahead = F.aggregate(
        "cores",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("back"), F.array().cast("array<struct<start:int,back:string>>").alias("all")),
        lambda a, c: F.struct(
            (a["at"] + F.length(c)).alias("at"),
            (F.right(F.concat(a["back"], c), F.lit(overlap)) if overlap else F.lit("")).alias("back"),
            F.concat(a["all"], F.array(F.struct(a["at"].alias("start"), a["back"].alias("back")))).alias("all"),
        ),
        lambda a: a["all"],
    )
    one = cores.withColumn("ahead", ahead).select("page_id", "section_no", "n_pieces", F.posexplode(F.arrays_zip("cores", "ahead")).alias("i", "p"))
    return one.select("page_id", "section_no", (F.col("i") + 1).alias("piece_no"), F.col("p.ahead.start").alias("start"), "n_pieces", F.concat("p.ahead.back", "p.cores").alias("piece"))
