"""Chat formatting from a declarative template.

A finite-state machine over roles judges the order of the turns. Every turn
becomes three text segments - header, body, end mark - with a loss flag each;
formatted text is the segments joined. Bodies and role names are escaped: each
of the template's lead characters and the escape character is coded as itself
plus the escape character, which is a prefix code, so nothing inside a text can
be read as a control string and unescaping is exact.

Defined cases: null text is empty; null role is an empty name; rows of a
conversation are ordered by turn (null first), then role, then text; repeated
rows are turns of their own; a role the machine doesn't know makes the
conversation invalid but it is formatted; a null conv_id is one conversation of
its own; an empty table gives an empty result; other columns are ignored, whatever
their names. A conversation is one row of the result, so its whole text must fit in
one (2 GB), however its turns are spread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings all begin with a character of ``leads``; ``escape`` may not be one of them."""

    open: str = "<|"
    close: str = "|>\n"
    end: str = "<|end|>\n"
    leads: str = "<["
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escaped(template: ChatTemplate, column: str) -> str:
    """SQL for the escaped form: each lead or escape character is followed by the escape character."""
    out = f"replace({column}, {_quoted(template.escape)}, {_quoted(template.escape * 2)})"
    for lead in template.leads:
        out = f"replace({out}, {_quoted(lead)}, {_quoted(lead + template.escape)})"
    return out


def unescaped(template: ChatTemplate, column: str) -> str:
    """SQL for the inverse: the first of each coded pair, read from the left."""
    special = "".join("\\" + c for c in template.leads + template.escape)
    return f"regexp_replace({column}, {_quoted(f'([{special}])' + chr(92) * 2)}, '$1')"


def _machine(template: ChatTemplate) -> Column:
    """Index of the first turn the machine refuses (-1: none), and whether the last state is final."""
    table = "map(" + ", ".join(_quoted(f"{s}>{r}") + ", " + _quoted(n) for s, moves in template.moves.items() for r, n in moves.items()) + ")"
    step = f"try_element_at({table}, concat(a.state, '>', x.role))"
    walk = (
        "aggregate(turns, struct('start' as state, 0 as i, -1 as bad), (a, x) -> "
        f"struct(if(a.bad >= 0 or {step} is null, a.state, {step}) as state, a.i + 1 as i, if(a.bad < 0 and {step} is null, a.i, a.bad) as bad))"
    )
    return F.expr(walk)


def format_conversations(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, valid, bad_turn, segments array<struct<text, loss>> and formatted text of each conversation."""
    t = template or ChatTemplate()
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # array_sort puts null fields last, so order null turns first explicitly
    convs = convs.withColumn("turns", F.expr("concat(filter(turns, x -> x.turn is null), filter(turns, x -> x.turn is not null))"))
    convs = convs.withColumn("walk", _machine(t))
    loss = ", ".join(_quoted(r) for r in t.loss_roles)
    parts = (
        f"flatten(transform(turns, x -> array(struct(concat({_quoted(t.open)}, {escaped(t, 'x.role')}, {_quoted(t.close)}) as text, false as loss), "
        f"struct({escaped(t, 'x.text')} as text, x.role in ({loss}) as loss), struct({_quoted(t.end)} as text, false as loss))))"
    )
    final = ", ".join(_quoted(s) for s in t.final)
    return convs.select(
        "conv_id",
        F.expr(f"walk.bad < 0 and walk.state in ({final})").alias("valid"),
        F.expr("walk.bad").alias("bad_turn"),
        F.expr(parts).alias("segments"),
    ).withColumn("formatted", F.expr("array_join(transform(segments, s -> s.text), '')"))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The turns array<struct<role, text>> read from formatted text alone."""
    t = template or ChatTemplate()
    split = f"split(formatted, {_quoted(chr(92) + 'Q' + t.end + chr(92) + 'E')}, -1)"
    close = _quoted(t.close)
    turn = f"struct({unescaped(t, f'substring(p, {len(t.open) + 1}, instr(p, {close}) - {len(t.open) + 1})')} as role, {unescaped(t, f'substring(p, instr(p, {close}) + {len(t.close)})')} as text)"
    return formatted.withColumn("read", F.expr(f"transform(slice({split}, 1, size({split}) - 1), p -> {turn})"))
