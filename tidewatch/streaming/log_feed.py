"""Multi-line log events of lines that land in batches, by built-in operations only.

A batch's lines are gathered by block and folded to parts once, as in ``multiline``.  Events that
open and close inside a block are done there.  What meets by file are the first and last parts of
blocks and, from the batches before, the one event the file still has open; so a file that holds
most of the lines is spread over its blocks.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import parse_duration
from tidewatch.operators.log_events import segments_of
from tidewatch.schema.fixed_values import LINE_TIMEOUT, LOG_EVENT_START
from tidewatch.sinks.batch_tables import FOLDER, BatchTables, folder_of

_PART = "block: bigint, pos: bigint, kept: array<string>, n_lines: bigint"


class LogEventFeed:
    """Events of lines (file, block, pos, value) as batches come (``run_batches``).

    An event is emitted when the next one opens, when its file's end mark (a null value) arrives,
    or with the first batch that comes ``timeout`` after the file's last lines; ``None`` waits for
    good.  A file's lines come in order.  The open event of each file is kept by hash folder.
    With ``max_lines`` an event keeps its first lines only, and no more are kept of an open one.
    """

    OPEN = f"file string, open struct<{_PART}>, seen_at timestamp, {FOLDER} int"
    EVENTS = (
        "file string, block bigint, pos bigint, message string, n_lines bigint, truncated boolean"
    )

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        timeout: str | None = LINE_TIMEOUT,
        pattern: str = LOG_EVENT_START,
        negate: bool = True,
        max_lines: int | None = None,
    ):
        self.tables, self.timeout, self.max_lines = BatchTables(spark, root), timeout, max_lines
        self.pattern, self.negate = pattern, negate

    def apply(self, lines: DataFrame, batch: int, clock: datetime | None = None) -> bool:
        """Take in a batch of lines, at the time ``clock``; false if it has been here before."""
        tables = self.tables.within(lines.sparkSession)
        clock = clock or datetime.now(timezone.utc)

        def advance() -> None:
            parts = tables.write("parts", batch, self._parts(lines))
            inside = (F.col("nth") > 0) & (F.col("nth") < F.col("openings"))
            whole = parts.filter(inside & (F.col("n_lines") > 0))
            edges = parts.filter(~inside)
            files = edges.select("file").distinct()
            touched = [r[0] for r in edges.select(folder_of("file")).distinct().collect()]
            known = None if self.timeout else touched
            latest = F.max_by(F.struct("open", "seen_at"), "batch").alias("latest")
            held = tables.read("open", self.OPEN, known).groupBy("file").agg(latest)
            held = held.filter("latest.open IS NOT NULL").select("file", "latest.*")
            carried = held.join(files, "file", "left_semi").select(
                "file", F.lit(0).alias("turn"), F.lit(True).alias("opens"), "open.*"
            )
            arrived = edges.select(
                "file", F.lit(1).alias("turn"), (F.col("nth") > 0).alias("opens"),
                "block", "pos", "kept", "n_lines",
            )
            merged = tables.write("merged", batch, self._merged(carried.unionByName(arrived)))
            done = [whole, merged.filter("NOT last AND n_lines > 0")]
            going = [merged.filter("last")]
            if self.timeout:
                silent = clock - timedelta(milliseconds=parse_duration(self.timeout))
                over = held.filter(F.col("seen_at") <= F.lit(silent)).join(files, "file", "left_anti")
                done.append(over.select("file", "open.*"))
                going.append(over.select("file", "open.*").withColumn("n_lines", F.lit(0).cast("bigint")))
            part = F.struct("block", "pos", "kept", "n_lines")
            state = [
                rows.select("file", F.when(F.col("n_lines") > 0, part).alias("open")) for rows in going
            ]
            tables.write("events", batch, _all(self._shown(rows) for rows in done))
            kept = _all(state).withColumns({"seen_at": F.lit(clock), FOLDER: folder_of("file")})
            tables.write("open", batch, kept, by=[FOLDER])

        return tables.once(batch, advance)

    def _parts(self, lines: DataFrame) -> DataFrame:
        opens = F.col("value").rlike(self.pattern)
        opens = F.coalesce(opens if self.negate else ~opens, F.lit(True))
        placed = lines.filter("file IS NOT NULL AND block IS NOT NULL")
        line = F.struct("pos", opens.alias("opens"), "value")
        blocks = placed.groupBy("file", "block").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
        # One more line is looked at, in case the first is an end mark.
        limit = None if self.max_lines is None else self.max_lines + 1
        parts = blocks.select("file", "block", *segments_of(limit)).select(
            "file", "block", F.size("_starts").alias("openings"), F.inline("_parts")
        )
        mark = (F.col("nth") > 0) & F.get("kept", F.lit(0)).isNull()
        return parts.withColumns(
            {
                "kept": self._cut(F.when(mark, F.slice("kept", 2, 2**31 - 1)).otherwise(F.col("kept"))),
                "n_lines": F.col("n_lines") - mark.cast("bigint"),
            }
        )

    def _cut(self, lines):
        return lines if self.max_lines is None else F.slice(lines, 1, self.max_lines)

    def _merged(self, edges: DataFrame) -> DataFrame:
        """Parts of one event together; ``last``: nothing has closed it, or nothing is open."""
        order = Window.partitionBy("file").orderBy("turn", "block", "pos")
        numbered = edges.withColumn("event", F.sum(F.col("opens").cast("int")).over(order))
        numbered = numbered.withColumn("last", F.max("event").over(Window.partitionBy("file")))
        piece = F.struct("turn", "block", "pos", "kept", "n_lines")
        return (
            numbered.groupBy("file", "event", (F.col("event") == F.col("last")).alias("last"))
            .agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("n_lines").alias("n_lines"))
            .select(
                "file",
                F.get("pieces", F.lit(0))["block"].alias("block"),
                F.get("pieces", F.lit(0))["pos"].alias("pos"),
                self._cut(F.flatten("pieces.kept")).alias("kept"),
                "n_lines",
                "last",
            )
        )

    def _shown(self, rows: DataFrame) -> DataFrame:
        cut = F.lit(False) if self.max_lines is None else F.col("n_lines") > self.max_lines
        message = F.array_join("kept", "\n").alias("message")
        return rows.select("file", "block", "pos", message, "n_lines", cut.alias("truncated"))

    def events(self, batch: int | None = None) -> DataFrame:
        """Events so far, or those a batch has brought."""
        rows = self.tables.read("events", self.EVENTS)
        return (rows if batch is None else rows.filter(F.col("batch") == batch)).drop("batch")

    def fold(self) -> None:
        """Keep one row per file with an open event for the batches so far."""
        latest = F.max_by(F.struct("open", "seen_at"), "batch").alias("latest")
        self.tables.fold(
            "open",
            self.OPEN,
            lambda rows: rows.groupBy("file", FOLDER)
            .agg(latest)
            .filter("latest.open IS NOT NULL")
            .select("file", "latest.*", FOLDER),
            by=[FOLDER],
        )


def _all(parts) -> DataFrame:
    first, *rest = parts
    for rows in rest:
        first = first.unionByName(rows)
    return first
