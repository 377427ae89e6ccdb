"""Chat formatting by a declarative template, and reading it back.

The template states how a turn is opened and closed and which roles are trained on. A finite-state machine over
roles, given as its allowed steps, validates turn order. Each conversation becomes
segments (text, loss): an opening and a closing segment around each turn's text. Control
strings inside texts and roles are escaped reversibly, so that the formatted
string can be parsed without the segments.

All is DataFrame functions. Turns are first gathered in blocks of `BLOCK` consecutive turn numbers, then the blocks
of a conversation; so a long conversation is assembled by many tasks before its few blocks meet.

Edge cases: a null text is an empty one, a null role is an empty role, a null conversation id is a conversation. Turns are ordered
by number (nulls first), then role, then text; repeated turns are turns. Conversations whose order the machine does not accept are
formatted all the same and have valid = false. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    head: str = "\n"
    close: str = "<|im_end|>\n"
    control: str = "<|"
    escaped: str = "<\\|"
    trained: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; the machine starts in "start" and may end in `final`.
    steps: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("asked", "answered")


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(template.control), F.lit(template.escaped))


def unescape(text: Column, template: Template = CHATML) -> Column:
    return F.replace(F.replace(text, F.lit(template.escaped), F.lit(template.control)), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column, template: Template = CHATML) -> Column:
    """Roles also lose line feeds, which end the head; with % as the sign of an escape."""
    first = template.control[0]
    out = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.replace(out, F.lit(template.control), F.lit(f"%{ord(first):02X}{template.control[1:]}"))


def unescape_role(role: Column, template: Template = CHATML) -> Column:
    first = template.control[0]
    out = F.replace(F.replace(role, F.lit(f"%{ord(first):02X}"), F.lit(first)), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def machine(roles: Column, template: Template = CHATML) -> Column:
    """Whether the machine accepts the roles in this order."""
    table = F.create_map(*[F.lit(x) for s, r, t in template.steps for x in (f"{s}\x00{r}", t)])
    end = F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\x00"), role)), F.lit("rejected")))
    return end.isin(*template.final)


def format_conversations(turns: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: its id, valid, segments array<struct<text, loss>>, formatted (the segments joined)."""
    rows = turns.select(
        F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    blocks = rows.groupBy("__conv", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = blocks.groupBy("__conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "turns"))), lambda b: b["turns"])).alias("turns"))

    def parts(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.open), escape_role(t["role"], template), F.lit(template.head)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    made = whole.select(
        F.col("__conv").alias(conv), machine(F.col("turns.role"), template).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments")
    )
    return made.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: DataFrame, template: Template = CHATML, conv: str = "conv_id") -> DataFrame:
    """Turns parsed from the formatted string alone, and the trained text from the segments: conv, turns array<struct<role, text>>, loss array<string>, formatted."""
    pieces = F.slice(F.split(F.col("formatted"), _literal(template.open)), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        end = F.instr(piece, template.head)
        body = F.substr(piece, end + len(template.head), F.length(piece) - end - len(template.head) - len(template.close) + 1)
        return F.struct(unescape_role(F.substr(piece, F.lit(1), end - 1), template).alias("role"), unescape(body, template).alias("text"))

    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return formatted.select(F.col(conv), F.transform(pieces, turn).alias("turns"), trained.alias("loss"), "formatted", "valid")


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in text)


def digests(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
