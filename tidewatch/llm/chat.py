"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation becomes a list of segments, each with a flag that says whether it counts for
the loss; the segments joined are the formatted text.  The machine runs over the roles in
turn order and says whether they take turns as declared; conversations out of order are
formatted all the same and marked.  Only built-in functions are used.

Inside texts and roles, a backslash is doubled and a control string gets one backslash after
its first character, so no text can pose as a turn mark; ``unescape`` undoes it exactly.

Null texts count as empty; a null role as the empty role, which the machine knows no move
for.  Rows are ordered by turn, then role and text (nulls first), so ties and repeated rows
have one result.  Rows without conversation id form one conversation without id.  Other
columns are left out.  The turns of one conversation meet in one row, as its text does: a
conversation is the unit of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """How turns are marked and which roles may follow each other."""

    role_open: str = "<|"
    role_close: str = "|>"
    turn_close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            START: {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)
    #: what may not stand in a text: first character, then what follows it, as patterns
    controls: tuple[tuple[str, str], ...] = ((r"<", r"\||/?s>"), (r"\|", r">"), (r"\[", r"/?INST\]"))


LLM_CHAT = Template()


def escape(text: Column, template: Template = LLM_CHAT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, rest in template.controls:
        text = F.regexp_replace(text, f"({first})(?={rest})", r"$1\\")
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def last_state(roles: Column, template: Template = LLM_CHAT) -> Column:
    """The machine's state after all roles, ``broken`` once no move fits."""
    moves = F.create_map(
        *(
            F.lit(word)
            for state, by_role in template.moves.items()
            for role, to in by_role.items()
            for word in (f"{state}>{role}", to)
        )
    )
    step = lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit(BROKEN)
    )
    return F.aggregate(roles, F.lit(START), step)


def format_conversations(rows: DataFrame, template: Template = LLM_CHAT) -> DataFrame:
    """One row per conversation: segments with loss flags, formatted text, loss spans, order.

    ``loss_spans`` holds start (from 0) and length of each flagged segment in code points.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    per_turn = lambda t: F.array(
        segment(
            F.concat(
                F.lit(template.role_open), escape(t["role"], template), F.lit(template.role_close)
            ),
            F.lit(False),
        ),
        segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.turn_close), F.lit(False)),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")
    )
    walk = lambda done, s: F.struct(
        (done["at"] + F.length(s["text"])).alias("at"),
        F.when(
            s["loss"],
            F.array_append(
                done["spans"],
                F.struct(done["at"].alias("start"), F.length(s["text"]).alias("length")),
            ),
        )
        .otherwise(done["spans"])
        .alias("spans"),
    )
    state = last_state(F.transform("turns", lambda t: t["role"]), template)
    return (
        turns.select(
            "conv_id",
            state.alias("state"),
            F.flatten(F.transform("turns", per_turn)).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("loss_spans", F.aggregate("segments", start, walk)["spans"])
        .withColumn("in_order", F.col("state").isin(*template.final))
    )


def read_back(formatted: DataFrame, template: Template = LLM_CHAT) -> DataFrame:
    """Turns and loss texts, recovered from formatted text and spans alone."""
    marked = F.split("formatted", _literal(template.turn_close))
    whole = F.slice(marked, 1, F.size(marked) - 1)
    close = F.lit(template.role_close)
    cut = lambda t: F.locate(template.role_close, t)
    opened = len(template.role_open)
    turn = lambda t: F.struct(
        unescape(F.substring(t, F.lit(opened + 1), cut(t) - opened - 1)).alias("role"),
        unescape(F.substring(t, cut(t) + F.length(close), F.length(t))).alias("text"),
    )
    loss = lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"])
    )
    return formatted.withColumn("read_turns", F.transform(whole, turn)).withColumn(
        "loss_texts", F.transform("loss_spans", loss)
    )


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def digests(formatted: DataFrame, template: Template = LLM_CHAT) -> DataFrame:
    """What was formatted, as counts and digests of what reading back gives."""
    back = read_back(formatted, template)
    lines = F.transform(
        "read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "in_order",
    )
