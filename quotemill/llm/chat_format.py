"""Chat formatting: a turn-order state machine and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are learned, and which strings texts may not contain raw.

    ``head`` holds {role}; head and tail, the escape character included, stand in no escaped text.
    """

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    #: (state, role) -> state; any other pair leads to the invalid state. A conversation is valid in a state of ``final``.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)

    def first_characters(self) -> list[str]:
        """Control strings begin with these; in texts each is written as the escape character and its index."""
        return sorted({c[0] for c in self.control} | {self.head[0], self.tail[0]})


CHATML = Template()
INVALID = "invalid"


def escaped(text: Column, t: Template = CHATML) -> Column:
    """No control string is left raw: their first characters become the escape character and a letter."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "e"))
    for i, c in enumerate(t.first_characters()):
        out = F.replace(out, F.lit(c), F.lit(t.escape + chr(ord("f") + i)))
    return out


def unescaped(text: Column, t: Template = CHATML) -> Column:
    """The inverse of escaped(): after escaping, an escape character always begins a two-character code."""
    out = text
    for i, c in enumerate(t.first_characters()):
        out = F.replace(out, F.lit(t.escape + chr(ord("f") + i)), F.lit(c))
    return F.replace(out, F.lit(t.escape + "e"), F.lit(t.escape))


def _role(role: Column) -> Column:
    """Line ends in a role would end its line: they are escaped too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> one row for each conversation.

    Columns: conv_id; formatted (string); segments (array of text, learned: their texts joined are
    ``formatted``); spans (array of start, length in code points: the learned parts); states (the machine's
    state after each turn); valid (the order is allowed and ends in a final state).

    Null role or text: empty. Ties in ``turn`` (and null turns, which come first) are ordered by role and text.
    Repeated rows stay. Other columns are ignored. Rows with a null conv_id form one conversation. An empty
    table gives an empty result. A conversation is one row of output by definition, so its turns meet in one row.
    """
    t = template
    move = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}>{role}", to)])
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head, tail = t.head.split("{role}")[0], t.head.split("{role}")[1]
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(head), _role(x.role), F.lit(tail)).alias("text"), F.lit(False).alias("learned")),
                F.struct(escaped(x.text, t).alias("text"), x.role.isin(*t.learned).alias("learned")),
                F.struct(F.lit(t.tail).alias("text"), F.lit(False).alias("learned")),
            ),
        )
    )
    out = talks.withColumn("segments", segments)
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
    at = F.aggregate(
        "segments",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s.text)).alias("at"),
            F.when(s.learned, F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(s.text).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    states = F.aggregate(
        "turns",
        F.array(F.lit("start")),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(move, F.concat(F.element_at(a, -1), F.lit(">"), x.role)), F.lit(INVALID)))),
    )
    out = out.withColumn("spans", at["spans"]).withColumn("states", F.slice(states, 2, F.size(states) - 1))
    return out.withColumn("valid", F.element_at("states", -1).isin(*t.final)).select("conv_id", "formatted", "segments", "spans", "states", "valid")


def parse_formatted(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Reads (conv_id, formatted, spans) back: turns (array of role, text) and learned_text, both unescaped."""
    t = template
    head, tail = t.head.split("{role}")
    pieces = F.split("formatted", _quoted(t.tail), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    start = F.lit(len(head) + 1)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            _unrole(F.substr(p, start, F.locate(tail, p) - start)).alias("role"),
            unescaped(F.substr(p, F.locate(tail, p) + F.lit(len(tail))), t).alias("text"),
        ),
    )
    learned = F.array_join(F.transform("spans", lambda s: F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))), "")
    return formatted.withColumn("turns", turns).withColumn("learned_text", unescaped(learned, t))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}<>" else c for c in text)
