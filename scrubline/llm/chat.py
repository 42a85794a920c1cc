"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked, which of them are learned, and in which order they may come.

    ``titles`` names the mark of each role, ``learned`` the roles whose text carries loss. ``moves``
    maps (state, role) to the next state; ``accepting`` are the states a conversation may end in.
    A role without a title is marked ``### ?role: ``.
    """

    titles: dict = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant",
    })
    learned: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    accepting: tuple = ("asked", "answered")
    mark: str = "### "
    mark_end: str = ": "
    turn_end: str = "</turn>\n"
    escape: str = "\\"

    def control_strings(self) -> list[str]:
        marks = [f"{self.mark}{t}{self.mark_end}" for t in self.titles.values()]
        return [*marks, f"{self.mark}?", self.turn_end.rstrip("\n")]


def escaped(text: Column, template: ChatTemplate) -> Column:
    """``text`` with the escape character doubled and put inside every control string."""
    text = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    for control in template.control_strings():
        text = F.replace(text, F.lit(control), F.lit(control[0] + template.escape + control[1:]))
    return text


def unescaped(text: Column, template: ChatTemplate) -> Column:
    """The inverse of ``escaped``: an escape character stands for the character after it."""
    return F.regexp_replace(text, r"(?s)" + "\\" + template.escape + "(.)", "$1")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def final_state(roles: Column, template: ChatTemplate) -> Column:
    """The state after reading the array of roles; null once a turn is out of order."""
    moves = _lookup({f"{s}>{r}": to for (s, r), to in template.moves.items()})
    return F.aggregate(
        roles, F.lit("start").cast("string"),
        lambda state, role: F.try_element_at(moves, F.concat(state, F.lit(">"), role)),
    )


def format_chats(
    df: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, n_turns, valid_order, segments) for every conversation.

    ``segments`` holds (text, loss) in order: the mark of a turn, its escaped text, its end. Joined,
    they are the formatted conversation. Turns are ordered by ``turn``, equal ones by role and text,
    missing ones first. A null text or role is an empty one; rows without a conversation id form one
    conversation. ``valid_order`` is false if the state machine has no move for a turn or ends in a
    state that is not accepting; such conversations are formatted all the same. An empty table gives
    no rows; further columns are ignored. Built from column expressions only: one shuffle by
    conversation, and each conversation becomes one row.
    """
    titles = _lookup({r: f"{template.mark}{t}{template.mark_end}" for r, t in template.titles.items()})
    rows = df.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = rows.groupBy("_conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    # A role without a title keeps its name, whose colons are escaped for the reader.
    other = lambda r: F.concat(
        F.lit(f"{template.mark}?"),
        F.replace(escaped(r, template), F.lit(":"), F.lit(template.escape + ":")),
        F.lit(template.mark_end),
    )
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.coalesce(F.try_element_at(titles, t["role"]), other(t["role"])).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(escaped(t["text"], template).alias("text"),
                 t["role"].isin(list(template.learned)).alias("loss")),
        F.struct(F.lit(template.turn_end).alias("text"), F.lit(False).alias("loss")),
    )))
    state = final_state(F.col("turns.role"), template)
    return turns.select(
        F.col("_conv").alias(conv), F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(state.isin(list(template.accepting)), F.lit(False)).alias("valid_order"),
        segments.alias("segments"),
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The array of (role, text) that a formatted conversation was made of."""
    pieces = F.split(formatted, "\\Q" + template.turn_end + "\\E", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    esc = "\\" + template.escape
    other = rf"(?s)\A\Q{template.mark}?\E((?:[^:{esc}]|{esc}.)*+)\Q{template.mark_end}\E"

    def turn_of(piece: Column) -> Column:
        name, body = F.regexp_extract(piece, other, 1), F.regexp_replace(piece, other, "")
        role = unescaped(name, template)
        for known, title in template.titles.items():
            start = f"{template.mark}{title}{template.mark_end}"
            role = F.when(piece.startswith(start), F.lit(known)).otherwise(role)
            body = F.when(piece.startswith(start), F.substring(piece, len(start) + 1, 1 << 30)).otherwise(body)
        return F.struct(role.alias("role"), unescaped(body, template).alias("text"))

    return F.transform(pieces, turn_of)


def loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescaped(s["text"], template)), "")
