"""Chat formatting by a state machine over roles and a declarative template.

Only DataFrame expressions. The state machine runs over the ordered turns of each
conversation as a window of the previous role; every turn becomes three text segments
(head, body, foot), and only bodies of trained roles carry loss. Control strings
inside texts are escaped so that the formatted text can be taken apart again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenframe.llm.common import text_of

START = "start"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are trained on, and which role may follow which.

    head, sep and foot surround role and text: head + role + sep + text + foot. head and
    foot must begin with opener. follows maps a role (or "start") to the roles that may
    come next; ends holds the roles a conversation may end with.
    """

    head: str = "<|im_start|>"
    sep: str = "\n"
    foot: str = "<|im_end|>\n"
    opener: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    ends: tuple[str, ...] = ("user", "assistant")


DEFAULT = Template()

# Escapes: every ampersand first, then what could open a control string.
_AMPERSAND = "&amp;"
_OPENER = "&lt;"
_NEW_LINE = "&nl;"


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Text in which the template's opener no longer occurs."""
    safe = F.replace(text, F.lit("&"), F.lit(_AMPERSAND))
    return F.replace(safe, F.lit(template.opener), F.lit(_OPENER + template.opener[1:]))


def unescape(text: Column) -> Column:
    """The text given to escape(); escaped openers begin with their first character."""
    return F.replace(F.replace(text, F.lit(_OPENER), F.lit("<")), F.lit(_AMPERSAND), F.lit("&"))


def escape_role(role: Column, template: Template = DEFAULT) -> Column:
    """A role in which neither opener nor separator occurs."""
    return F.replace(escape(role, template), F.lit(template.sep), F.lit(_NEW_LINE))


def unescape_role(role: Column, template: Template = DEFAULT) -> Column:
    return unescape(F.replace(role, F.lit(_NEW_LINE), F.lit(template.sep)))


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, turn, position, segment, text, loss, valid.

    Three rows per turn: segment 0, 1, 2 are head, body and foot; position numbers the
    turns of a conversation from 0. valid tells whether the turn may stand where it does.
    A null text or role is empty, and an empty or unknown role is never valid. Turns are
    ordered by turn, null first, ties by role and text, so repeated rows stay. A null
    conv_id is a conversation of its own. Other columns are not read; an empty table
    gives an empty result.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        text_of(F.col("role")).alias("role"),
        text_of(F.col("text")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role", 1, START).over(order)
    allowed = F.create_map(
        *(
            x
            for role, after in template.follows.items()
            for x in (F.lit(role), F.array(*(F.lit(a) for a in after)))
        )
    )
    last = F.lead("role").over(order).isNull()
    placed = clean.select(
        "conv_id",
        "turn",
        "role",
        "text",
        (F.row_number().over(order) - 1).alias("position"),
        (
            F.coalesce(F.array_contains(F.try_element_at(allowed, before), F.col("role")), F.lit(False))
            & (~last | F.col("role").isin(*template.ends))
        ).alias("valid"),
    )
    head = F.concat(F.lit(template.head), escape_role(F.col("role"), template), F.lit(template.sep))
    trained = F.col("role").isin(*template.loss_roles)
    parts = F.array(
        F.struct(F.lit(0).alias("segment"), head.alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("segment"), escape(F.col("text"), template).alias("text"), trained.alias("loss")),
        F.struct(F.lit(2).alias("segment"), F.lit(template.foot).alias("text"), F.lit(False).alias("loss")),
    )
    return placed.select("conv_id", "turn", "position", "valid", F.inline(parts)).select(
        "conv_id", "turn", "position", "segment", "text", "loss", "valid"
    )


def formatted(parts: DataFrame) -> DataFrame:
    """Segments -> conv_id, formatted, loss_spans (start, length in code points), valid.

    One row per conversation. A conversation is one text by nature, so all its turns
    meet in one row here; segments() has no such limit.
    """
    whole = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "segment", "text", "loss"))).alias("parts"),
        F.bool_and("valid").alias("valid"),
    )
    running = F.aggregate(
        "parts",
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
        ),
        lambda state, part: F.struct(
            (state["at"] + F.length(part["text"])).alias("at"),
            F.when(
                part["loss"],
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"]).alias("start"),
                            F.length(part["text"]).cast("long").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        running["spans"].alias("loss_spans"),
        "valid",
    )


def parsed(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Formatted rows -> conv_id, turns (role, text), loss_texts, formatted, valid: read back.

    Turns come from the marks in the formatted text, loss_texts from the loss spans, both
    unescaped.
    """
    # Before the first head there is nothing; no text holds a head or a foot.
    cut = F.split("formatted", F.lit(_literal(template.head)))
    bodies = F.filter(cut, lambda x, i: i > 0)
    turns = F.transform(
        bodies,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, template.sep, 1), template).alias("role"),
            unescape(
                F.substring(
                    x,
                    F.locate(template.sep, x) + len(template.sep),
                    F.length(x) - F.locate(template.sep, x) - len(template.sep) + 1 - len(template.foot),
                )
            ).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))),
    )
    return rows.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), "formatted", "valid")


def digests(conversations: DataFrame) -> DataFrame:
    """Parsed conversations -> the digest row of each."""
    said = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    trained = F.array_join("loss_texts", "")
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
