"""Chat formatting by a finite-state machine over roles and a declarative template, in DataFrame functions alone.

A conversation becomes a list of segments, each a text with a loss flag; joined, they are the formatted text. The template
says what a turn of a role opens and closes with and whether its text is learnt. The machine walks over the roles in order of
turns and says whether they are in a legal order and where they first aren't; an illegal conversation is formatted like others.

Control strings within texts are broken by a backslash after their first character, and backslashes are doubled, so no text can
open or close a turn and every text comes back as it was: ``read`` gets the turns back from the formatted text.

At scale: one shuffle by conv_id. A conversation is one text, so it is gathered in one row, as a document is; it may
take what Spark lets a string take (2 GB). The machine carries one state, the segments are joined once: nothing is quadratic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base


@dataclass(frozen=True)
class Mark:
    """What a turn opens and closes with (each holds one control string), and whether its text is learnt."""

    open: str
    close: str
    loss: bool = False


TEMPLATE = {
    "system": Mark("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": Mark("[INST] ", " [/INST]"),
    "assistant": Mark("<s>", "</s>", loss=True),
}
#: A turn of any other role: its name stands between the first two.
OTHER = ("[NAME]", "[/NAME]", "[/TURN]")

#: state, role -> state. What isn't here is no legal turn.
STEPS = {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
#: States in which a conversation may end.
ENDS = ("asked", "answered")


def controls(template: dict[str, Mark]) -> list[str]:
    return [s.strip() for m in template.values() for s in (m.open, m.close)] + list(OTHER)


def escape(text: Column, template: dict[str, Mark] = TEMPLATE) -> Column:
    first = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls(template))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({first})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: dict[str, Mark], of, other: Column) -> Column:
    for name, mark in template.items():
        other = F.when(role == name, F.lit(of(mark))).otherwise(other)
    return other


def turns(convs: DataFrame) -> DataFrame:
    """conv_id and its turns in order: array of (turn, role, text). Null roles and texts count as empty; of turns with one
    number (null first) the order is by role and text."""
    part = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return convs.select("conv_id", part.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def walk(roles: Column) -> Column:
    """(state, fault) after the roles: fault is the place, from 1, of the first turn that no step leads to, null if there is none.
    After a fault the state stays."""
    steps = F.create_map(*[F.lit(x) for (state, role), to in STEPS.items() for x in (f"{state} {role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("fault"))

    def step(acc: Column, role: Column) -> Column:
        to, n = F.try_element_at(steps, F.concat_ws(" ", acc["state"], role)), acc["n"] + 1
        lost = acc["fault"].isNotNull() | to.isNull()
        return F.struct(F.when(lost, acc["state"]).otherwise(to).alias("state"), n.alias("n"), F.coalesce(acc["fault"], F.when(to.isNull(), n)).alias("fault"))

    return F.aggregate(roles, start, step)


def format(convs: DataFrame, template: dict[str, Mark] = TEMPLATE) -> DataFrame:
    """One row for each conv_id of ``convs`` (conv_id, turn, role, text; further columns are ignored): conv_id, segments (array
    of (text, loss)), valid, fault.

    valid: the machine takes all turns and may end there; fault as in ``walk``. A null conv_id is a conversation like others.
    Rows that repeat a turn are turns like others; a role that the template hasn't is written out by name. An empty table gives
    an empty result.
    """

    def emit(t: Column) -> Column:
        role = t["role"]
        head = _by_role(role, template, lambda m: m.open, F.concat(F.lit(OTHER[0]), escape(role, template), F.lit(OTHER[1])))
        tail = _by_role(role, template, lambda m: m.close, F.lit(OTHER[2]))
        loss = _by_role(role, template, lambda m: m.loss, F.lit(False))
        segment = lambda text, learnt: F.struct(text.alias("text"), learnt.alias("loss"))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"], template), loss), segment(tail, F.lit(False)))

    end = F.col("end")
    out = turns(convs).select("conv_id", F.flatten(F.transform("turns", emit)).alias("segments"), walk(F.transform("turns", lambda t: t["role"])).alias("end"))
    return out.select("conv_id", "segments", (end["fault"].isNull() & end["state"].isin(*ENDS)).alias("valid"), end["fault"].alias("fault"))


def text_of(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt(segments: Column) -> Column:
    """What stands under the loss mask, as the turns have it."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read(formatted: Column, template: dict[str, Mark] = TEMPLATE) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    known = "|".join(f"{re.escape(m.open)}.*?{re.escape(m.close)}" for m in template.values())
    other = ".*?".join(re.escape(s) for s in OTHER)

    def turn(piece: Column) -> Column:
        name = F.substring_index(piece, OTHER[1], 1).substr(F.lit(len(OTHER[0]) + 1), F.length(piece))
        skip, rest = F.length(name) + len(OTHER[0]) + len(OTHER[1]), F.lit(len(OTHER[2]))
        role = unescape(name)
        for r, m in template.items():
            hit = F.startswith(piece, F.lit(m.open))
            role, skip, rest = (F.when(hit, F.lit(new)).otherwise(old) for new, old in ((r, role), (len(m.open), skip), (len(m.close), rest)))
        return F.struct(role.alias("role"), unescape(piece.substr(skip + 1, F.length(piece) - skip - rest)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s){known}|{other}"), F.lit(0)), turn)


def digests(convs: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, fault of each conversation, read back from its formatted text and segments."""
    made = format(convs).select("conv_id", "valid", "fault", "segments", text_of(F.col("segments")).alias("formatted"))
    back = made.select("conv_id", "valid", "fault", F.length("formatted").cast("long").alias("formatted_chars"), read(F.col("formatted")).alias("back"), learnt(F.col("segments")).alias("learnt"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "fault",
    )


#: Both turns of the conversation that the query adds.
PLANTED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-1, k, role, PLANTED) for k, role in enumerate(("user", "assistant"))]
    return digests(convs.union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    broken = quote("|".join(re.escape(c).replace("/", "\\/") for c in controls(TEMPLATE)))
    grown = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, {broken}))"
    marks = " ".join(f"WHEN {quote(r)} THEN {len(m.open) + len(m.close)}" for r, m in TEMPLATE.items())
    learnt = ", ".join(quote(r) for r, m in TEMPLATE.items() if m.loss)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, {quote(PLANTED)} FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)
), s AS (
  SELECT *, {grown("text")} + CASE role {marks} ELSE {sum(map(len, OTHER))} + {grown("role")} END AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM t
), p AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 'start') AS before FROM s
), f AS (
  SELECT *, coalesce((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')), false)
            AND (before <> 'start' OR pos = 1) AS legal
  FROM p
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role IN ({learnt})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role IN ({learnt})), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(legal) AND max_by(role, pos) IN ('user', 'assistant') AS valid,
       (min(pos) FILTER (NOT legal))::INTEGER AS fault
FROM f GROUP BY conv_id
"""


QUERIES = {"op11_chat_format": op11_chat_format}
ORACLE = {"op11_chat_format": _sql()}
