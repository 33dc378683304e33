"""Chat formatting with DataFrame functions only: a declarative template, a finite-state machine over roles, reversible
escapes, text segments with loss flags, and the way back from the formatted text.

A conversation's turns are gathered in pieces of at most ``PIECE`` turns and the pieces joined afterwards, so that a
conversation with very many turns is neither sorted nor formatted in one task; what is joined is one string for a piece.
The machine is run on each piece from every state at once. That gives the piece's function from states to states, and
the functions of a conversation's pieces are composed in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of a conversation that one group gathers.
PIECE = 256


@dataclass(frozen=True)
class Template:
    """How turns are written. ``names`` gives the header's name of each role and must not repeat one; other roles are
    written as they are, after ``other``. ``escapes`` are the control strings and the letter that stands for each after
    ``mark``; ``mark`` itself is doubled. ``transitions`` lists the roles that may follow a state, "" being the start;
    a role is the state after its turn. Turns of the roles in ``loss`` carry the loss."""

    head: str = "### "
    after: str = ": "
    end: str = " </turn>\n"
    other: str = "@"
    mark: str = "\\"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    escapes: dict[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "e"})
    role_escapes: dict[str, str] = field(default_factory=lambda: {": ": "c", "@": "a"})
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    loss: tuple[str, ...] = ("assistant",)


def escape(text: Column, template: Template, also: dict[str, str] | None = None) -> Column:
    """The text without any control string: every mark doubled, then each control string replaced by mark + letter."""
    text = F.replace(text, F.lit(template.mark), F.lit(template.mark * 2))
    for control, letter in {**template.escapes, **(also or {})}.items():
        text = F.replace(text, F.lit(control), F.lit(template.mark + letter))
    return text


def unescape(text: Column, template: Template, also: dict[str, str] | None = None) -> Column:
    """The inverse of :func:`escape`. Split at doubled marks, taken from the left, a part has only single ones left."""

    def part(p: Column) -> Column:
        for control, letter in {**(also or {}), **template.escapes}.items():
            p = F.replace(p, F.lit(template.mark + letter), F.lit(control))
        return p

    doubled = "".join("\\" + c if not c.isalnum() else c for c in template.mark * 2)
    return F.array_join(F.transform(F.split(text, doubled, -1), part), template.mark)


def _header(role: Column, template: Template) -> Column:
    known = F.create_map(*[F.lit(x) for pair in template.names.items() for x in pair])
    return F.concat(F.lit(template.head), F.coalesce(F.element_at(known, role), F.concat(F.lit(template.other), escape(role, template, template.role_escapes))), F.lit(template.after))


def _role(name: Column, template: Template) -> Column:
    known = F.create_map(*[F.lit(x) for role, title in template.names.items() for x in (title, role)])
    return F.coalesce(F.element_at(known, name), unescape(F.substr(name, F.lit(len(template.other) + 1)), template, template.role_escapes))


def _machine(template: Template) -> tuple[list[str], Column]:
    """The states, the last of them the one that nothing leaves, and a map from "state>role" to the next state's number."""
    states = [*template.transitions, "*"]
    steps = [x for i, (state, roles) in enumerate(template.transitions.items()) for r in roles for x in (F.lit(f"{i}>{r}"), F.lit(states.index(r)))]
    return states, F.create_map(*steps)


def format_chat(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, valid, formatted, and ``segments``, an array of (text, loss)
    whose texts make up ``formatted``. ``valid`` says whether the machine accepts the roles in this order.

    Turns are ordered by turn number, then role, then text, nulls first; repeated rows are turns of their own. A null
    role or text counts as empty. A null conversation id is a conversation like any other. Only a turn's text, not its
    header, carries loss. Roles outside the template are formatted all the same and make the conversation invalid. An
    empty table gives an empty result; other columns are ignored.
    """
    template = template or Template()
    states, machine = _machine(template)
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), escape(text, template).alias("body"),
        _header(role, template).alias("header"), F.col(text_col).isNull().alias("no_text"),
    )
    # A piece holds consecutive turn numbers, rows that repeat one number go to one piece, and those without one come first.
    piece_of = F.coalesce(F.floor(F.col("turn") / F.lit(piece)), F.lit(-(1 << 62)))
    turn = F.struct("turn", "role", "no_text", "body", "header")
    pieces = rows.groupBy("conv_id", piece_of.alias("piece")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    loss = F.array(*[F.lit(r) for r in template.loss])
    segments = F.flatten(
        F.transform("turns", lambda t: F.array(
            F.struct(t["header"].alias("text"), F.lit(False).alias("loss")),
            F.struct(t["body"].alias("text"), F.array_contains(loss, t["role"]).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        ))
    )
    dead = len(states) - 1

    def step(state: Column, t: Column) -> Column:
        return F.coalesce(F.element_at(machine, F.concat(state.cast("string"), F.lit(">"), t["role"])), F.lit(dead))

    after = F.array(*[F.aggregate("turns", F.lit(i), step) for i in range(len(states))])
    made = pieces.select("conv_id", "piece", F.size("turns").cast("long").alias("n"), segments.alias("segments"), after.alias("after"))
    whole = made.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("piece", "after", "segments"))).alias("pieces"))
    final = F.aggregate("pieces", F.lit(0), lambda state, p: F.element_at(p["after"], state + 1))
    out = whole.select("conv_id", "n_turns", (final != dead).alias("valid"), F.flatten(F.transform("pieces", lambda p: p["segments"])).alias("segments"))
    return out.select("conv_id", "n_turns", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chat(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    template = template or Template()
    end = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in template.end)
    lines = F.filter(F.split(formatted, end, -1), lambda x: x != "")

    def turn(line: Column) -> Column:
        at = F.position(F.lit(template.after), line)
        name = F.substr(line, F.lit(len(template.head) + 1), at - F.lit(len(template.head) + 1))
        return F.struct(_role(name, template).alias("role"), unescape(F.substr(line, at + F.lit(len(template.after))), template).alias("text"))

    return F.transform(lines, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, without escapes, nothing between."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def chat_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted texts and segments of :func:`format_chat` read back to, as digests."""
    read = formatted.select("conv_id", "n_turns", "valid", parse_chat(F.col("formatted"), template).alias("read"), loss_text(F.col("segments"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )
