"""Multi-line log events from ordered lines.

A log file can be of any size, so nothing here depends on a whole file meeting in one
task: lines are put in order per block of a file, and a table with one row per block carries
the open event across block borders.  A block's lines fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.schema.fixed_values import LOG_EVENT_START


def multiline(
    lines: DataFrame,
    pattern: str = LOG_EVENT_START,
    negate: bool = True,
    max_lines: int | None = None,
) -> DataFrame:
    """Log events (file, event_seq, message, n_lines, truncated) from lines.

    Lines without a file or block are left out.  With ``max_lines`` an event keeps its first lines only; ``n_lines`` counts all it had.

    A block folds to the lines before its first opening, whole events, and the last event, which
    may go on.  Only first and last parts of blocks are gathered by event; whole events are done
    where the block is.
    """
    opens = F.col("value").rlike(pattern)
    opens = F.coalesce(opens if negate else ~opens, F.lit(False))
    line = F.struct("pos", opens.alias("opens"), "value")
    # Lines of a block are gathered where they are read, and shuffled once, by block.
    placed = lines.filter("file IS NOT NULL AND block IS NOT NULL")
    blocks = placed.groupBy("file", "block").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    segments = blocks.select("file", "block", *segments_of(max_lines))
    # From the same rows: Spark reads and shuffles the text once for both sides.
    counted = segments.select("file", "block", (F.size("_starts")).cast("bigint").alias("_openings"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_openings").over(earlier), F.lit(0).cast("bigint"))
    numbered = segments.join(counted.select("file", "block", before.alias("_before")), ["file", "block"])
    parts = numbered.select(
        "file", "block", "_before", F.size("_starts").alias("_openings"), F.inline("_parts")
    ).select(
        "file",
        "block",
        (F.col("_before") + F.col("nth")).alias("event_seq"),
        "kept",
        "n_lines",
        ((F.col("nth") == 0) | (F.col("nth") == F.col("_openings"))).alias("_edge"),
    )
    # Events between two openings of a block are whole; first and last parts may go on elsewhere.
    whole = parts.filter("NOT _edge").select("file", "event_seq", "kept", "n_lines")
    edges = (
        parts.filter("_edge")
        .groupBy("file", "event_seq")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "kept"))).alias("_kept"),
            F.sum("n_lines").alias("n_lines"),
        )
        .select("file", "event_seq", F.flatten("_kept.kept").alias("kept"), "n_lines")
    )
    kept = F.col("kept") if max_lines is None else F.slice("kept", 1, max_lines)
    cut = F.lit(False) if max_lines is None else F.col("n_lines") > max_lines
    return whole.unionByName(edges).select(
        "file", "event_seq", F.array_join(kept, "\n").alias("message"), "n_lines", cut.alias("truncated")
    )


def segments_of(max_lines: int | None) -> tuple[Column, Column]:
    """``_starts``, places of the opening lines of a block's ``_lines``, and ``_parts``: the lines
    before the first (``nth`` 0, if any) and each opening with the lines that follow it.  A part
    has its first position, the lines kept of it and their number before any were left out."""
    lines = F.col("_lines")
    marked = F.transform(lines, lambda line, i: F.when(line["opens"], i))
    starts = F.array_compact(marked)

    def part(nth: Column, start: Column, end: Column) -> Column:
        n = end - start
        length = n if max_lines is None else F.least(n, F.lit(max_lines))
        values = F.transform(F.slice(lines, start + 1, length), lambda line: line["value"])
        pos = F.get(lines, start)["pos"]
        return F.struct(
            nth.alias("nth"), pos.alias("pos"), values.alias("kept"), n.cast("bigint").alias("n_lines")
        )

    end = lambda i: F.coalesce(F.get(starts, i), F.size(lines))
    head = F.array(part(F.lit(0), F.lit(0), end(F.lit(0))))
    head = F.filter(head, lambda p: p["n_lines"] > 0)
    events = F.transform(starts, lambda start, k: part(k + 1, start, end(k + 1)))
    return starts.alias("_starts"), F.concat(head, events).alias("_parts")
