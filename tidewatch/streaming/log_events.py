"""Multi-line log events from a stream of lines.

Lines that lie together are folded into fragments where they are read, before any
shuffle.  Events that begin and end inside one batch of lines are done at that point;
only the first and last fragment of each batch go to the state kept per file, so a file
holding most of the lines costs its group little.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.durations import parse_duration
from tidewatch.schema.fixed_values import LINE_TIMEOUT, LOG_EVENT_START

# The functions below run on executors, which may not have this package: ship their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FRAGMENT = (
    "file string, block bigint, pos bigint, opens boolean, closed boolean, ends boolean, "
    "n_lines bigint, message string"
)
_EVENT = (
    "file string, block bigint, pos bigint, message string, n_lines bigint, truncated boolean"
)
_OPEN_EVENT = "block bigint, pos bigint, n_lines bigint, message string"
_EVENT_COLUMNS = ["file", "block", "pos", "message", "n_lines", "truncated"]


def fold_lines(lines: pd.DataFrame, pattern: str, negate: bool, max_lines: int) -> pd.DataFrame:
    """Fragments of a batch of lines, in order of (file, block, pos).

    A fragment ends where an event opens or where lines are missing; it is ``closed``
    when the very next line opens an event.  A null line marks the end of its file.
    """
    lines = lines.sort_values(["file", "block", "pos"], ignore_index=True)
    ends = lines["value"].isna()
    opens = lines["value"].fillna("").str.match(pattern, flags=re.ASCII)
    opens = (opens if negate else ~opens) & ~ends
    same = (lines["file"] == lines["file"].shift()) & (lines["block"] == lines["block"].shift())
    joins = same & (lines["pos"] == lines["pos"].shift() + 1) & ~ends & ~ends.shift(fill_value=False)
    fragment = (opens | ~joins).cumsum()
    nth = lines.groupby(fragment).cumcount()
    kept = lines["value"].fillna("").where(nth < max_lines)
    by_fragment = lines.assign(opens=opens, ends=ends, joins=joins).groupby(fragment)
    first = by_fragment.first()
    out = first[["file", "block", "pos", "opens", "ends"]].copy()
    out["closed"] = (first["opens"] & first["joins"]).shift(-1, fill_value=False)
    out["n_lines"] = by_fragment.size().where(~first["ends"], 0)
    out["message"] = kept.dropna().groupby(fragment).agg("\n".join)
    columns = ["file", "block", "pos", "opens", "closed", "ends", "n_lines", "message"]
    return out[columns].reset_index(drop=True)


def _fragments(
    lines: DataFrame, pattern: str, negate: bool, max_lines: int, whole: bool
) -> DataFrame:
    """Fragments that are whole events, or all the others."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                folded = fold_lines(batch, pattern, negate, max_lines)
                done = folded["opens"] & folded["closed"]
                yield folded[done if whole else ~done]

    return lines.select("file", "block", "pos", "value").mapInPandas(fold, _FRAGMENT)


def _joined(event: tuple, fragment, max_lines: int) -> tuple:
    block, pos, n_lines, message = event
    room = max_lines - n_lines
    if room > 0 and fragment.n_lines:
        message = "\n".join([message, *fragment.message.split("\n")[:room]])
    return block, pos, n_lines + fragment.n_lines, message


def multiline_stream(
    lines: DataFrame,
    timeout: str | None = LINE_TIMEOUT,
    pattern: str = LOG_EVENT_START,
    negate: bool = True,
    max_lines: int | None = None,
) -> DataFrame:
    """Log events of a stream of lines (file, block, pos, value).

    An event is emitted when the next one opens, when its file's end mark (a null value)
    arrives, or after ``timeout`` without a new line of the file.  ``block`` and ``pos``
    tell where it begins.  With ``max_lines`` an event keeps its first lines only.  Logs
    land as closed pieces: the file source reads a file once, and lines added later are lost.

    Timeouts run on the clock and keep a query going, so give none (``None``) for a run
    over landed data, which is to stop by itself.
    """
    wait_ms = parse_duration(timeout) if timeout else None
    max_lines = sys.maxsize if max_lines is None else max_lines
    clock = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout

    def shown(file: str, event: tuple) -> tuple:
        block, pos, n_lines, message = event
        return file, block, pos, message, n_lines, n_lines > max_lines

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        (file,) = key
        event = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([shown(file, event)], columns=_EVENT_COLUMNS)
            return
        done = []
        arrived = [row for batch in batches for row in batch.itertuples(index=False)]
        for fragment in sorted(arrived, key=lambda row: (row.block, row.pos)):
            if event is not None and (fragment.opens or fragment.ends):
                done.append(shown(file, event))
                event = None
            if fragment.ends:
                continue
            if event is None:
                event = (fragment.block, fragment.pos, fragment.n_lines, fragment.message)
            else:
                event = _joined(event, fragment, max_lines)
            if fragment.closed:
                done.append(shown(file, event))
                event = None
        if event is not None:
            state.update(event)
            if wait_ms:
                state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=_EVENT_COLUMNS)

    whole = _fragments(lines, pattern, negate, max_lines, whole=True).selectExpr(
        "file", "block", "pos", "message", "n_lines", f"n_lines > {max_lines} AS truncated"
    )
    edges = _fragments(lines, pattern, negate, max_lines, whole=False)
    carried = edges.groupBy("file").applyInPandasWithState(
        advance, _EVENT, _OPEN_EVENT, "append", clock
    )
    return whole.unionByName(carried)
