"""How often every distinct term occurs and in how many records, by an external sort and a run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTIAL = "term string, n_mentions bigint, n_inner bigint, edge string"


def normal_term(name: Column) -> Column:
    """Lower case, runs of whitespace as one blank, outer blanks removed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def _changes(column: pa.Array, before) -> np.ndarray:
    """True where a value differs from its predecessor; ``before`` is the last value of the batch ahead (or None)."""
    n = len(column)
    out = np.ones(n, dtype=bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        both_null = pc.and_(pc.is_null(a), pc.is_null(b))
        differ = pc.fill_null(pc.not_equal(a, b), True)
        out[1:] = pc.and_not(differ, both_null).to_numpy(zero_copy_only=False)
    if before is not None:
        out[0] = column[0].as_py() != before[0]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of one sorted partition.

    Terms that neither begin nor end the partition are complete and give one row. The first and the last term may go
    on in a neighbouring partition, as may their outermost records: those records are passed on by name (``edge``) and
    counted after merging; records between them are counted here (``n_inner``).
    """
    last = None  # (term, record, mention) of the previous row
    open_run = None  # [term, mentions, records, first record, last record] of the run not yet closed
    first_run = True

    def close(run, is_edge):
        term, mentions, records, first, final = run
        if not is_edge:
            return [(term, mentions, records, None)]
        edges = [x for x in dict.fromkeys((first, final)) if x is not None]
        return [(term, mentions, records - len(edges), None), *((term, 0, 0, x) for x in edges)]

    for batch in batches:
        if not batch.num_rows:
            continue
        term, record, mention = batch.column(0), batch.column(1), batch.column(2)
        new_term = _changes(term, last and (last[0],))
        new_record = new_term | _changes(record, last and (last[1],))
        new_mention = new_record | _changes(mention, last and (last[2],))
        counted = new_record & pc.is_valid(record).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_term)
        bounds = starts if len(starts) and starts[0] == 0 else np.concatenate(([0], starts))
        mentions = np.add.reduceat(new_mention.astype(np.int64), bounds)
        records = np.add.reduceat(counted.astype(np.int64), bounds)
        m, done = len(bounds), []

        def begin(i: int, bounds=bounds, mentions=mentions, records=records, counted=counted, term=term, record=record, n=batch.num_rows) -> list:
            at, end = int(bounds[i]), int(bounds[i + 1] if i + 1 < len(bounds) else n) - 1
            hit = np.flatnonzero(counted[at : end + 1])
            return [term[at].as_py(), int(mentions[i]), int(records[i]), record[at + int(hit[0])].as_py() if len(hit) else None, record[end].as_py()]

        head = begin(0)
        if open_run is not None and not new_term[0]:
            open_run[1] += head[1]
            open_run[2] += head[2]
            # nulls come first, so a run may have had no record yet
            open_run[3], open_run[4] = (head[3] if open_run[3] is None else open_run[3]), head[4]
        else:
            if open_run is not None:
                done += close(open_run, first_run)
                first_run = False
            open_run = head
        if m > 1:
            done += close(open_run, first_run)
            first_run = False
            open_run = begin(m - 1)
        if m > 2:  # runs that begin and end inside the batch
            inner = slice(1, m - 1)
            columns = [term.take(pa.array(bounds[inner])), pa.array(mentions[inner], pa.int64()), pa.array(records[inner], pa.int64()), pa.nulls(m - 2, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n_mentions", "n_inner", "edge"])
        k = batch.num_rows - 1
        last = (term[k].as_py(), record[k].as_py(), mention[k].as_py())
        if done:
            yield _rows(done)
    if open_run is not None:
        yield _rows(close(open_run, True))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("term", pa.string()), ("n_mentions", pa.int64()), ("n_inner", pa.int64()), ("edge", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)], [n for n, _ in kinds])


def term_counts(rows: DataFrame, term: Column, record: str, mention: str) -> DataFrame:
    """``(term, n_mentions, n_records)`` for every non-blank term.

    Pairs of term and record identifier are range-partitioned and sorted; the mention is the last part of the range
    key, so that a term, or even one term in one record, with a third of all rows is spread over many partitions.
    Rows delivered again (equal term, record and mention) count once; a null record counts as mention, not as record;
    an empty table gives no rows.
    """
    pairs = rows.select(term.alias("term"), F.col(record).cast("string").alias("record"), F.col(mention).alias("mention")).filter(F.col("term") != "")
    ordered = pairs.repartitionByRange("term", "record", "mention").sortWithinPartitions("term", "record", "mention")
    partial = ordered.mapInArrow(_scan, _PARTIAL)
    # equal (term, edge) rows of neighbouring partitions are one record
    merged = partial.groupBy("term", "edge").agg(F.sum("n_mentions").alias("m"), F.sum("n_inner").alias("r"))
    return merged.groupBy("term").agg(F.sum("m").alias("n_mentions"), (F.sum("r") + F.count("edge")).alias("n_records"))


def mark_terms(counts: DataFrame, n_records: int | Column, rare_below: int = 3, common_above: float = 0.10) -> DataFrame:
    """Add ``mark``: ``rare`` below ``rare_below`` records, ``common`` above that share of ``n_records``, else null."""
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * n_records, "common")
    return counts.withColumn("mark", mark)
