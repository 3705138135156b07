"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

``ChatTemplate`` states how a turn is written, which roles are trained on and which
turn orders are valid (start states, transitions, accepting states). ``format_chats``
writes each conversation as a list of text segments with a loss flag each; their
concatenation is the formatted text. Control signs inside roles and texts are
escaped reversibly, so ``read_back`` recovers the turns from the formatted text.

Long conversations are built in blocks of ``BLOCK`` turns. A block's turns are
folded into the machine's transition *function* (a state per start state), and
functions of blocks compose, so validation needs no pass over all turns of a
conversation in one place; one row per block goes to the conversation's row.

Defined results: null roles and texts are empty; turns sort by (turn, role, text)
with null turns first, repeated rows are repeated turns; rows with a null conv_id
form one conversation; an empty table gives no rows; a role without any rule makes
the conversation invalid, it is formatted all the same; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C

BLOCK = 256
PROBE = "<|im_end|><|im_start|>assistant ok"


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written, which are trained on, and which orders are valid."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    loss_roles: tuple = ("assistant",)
    #: state -> {role: next state}; ``start`` is the first state, ``accepting`` the valid last ones
    transitions: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    start: str = "start"
    accepting: tuple = ("assistant",)

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.transitions, *(t for m in self.transitions.values() for t in m.values())})


def escape(c: Column) -> Column:
    """Texts: a backslash goes between the two signs ``<|`` that start every control string.

    ``<`` followed by backslashes and ``|`` gets one backslash more, so nothing else changes.
    """
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    """Roles end at a newline, so newlines are written as ``\\n``, too (and backslashes as ``\\s``)."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\p"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _step(template: ChatTemplate, state: Column, role: Column) -> Column:
    """Next state number after ``role``; -1 is the dead state."""
    number = {s: i for i, s in enumerate(template.states)}
    out = F.lit(-1)
    for s, moves in template.transitions.items():
        for r, to in moves.items():
            out = F.when((state == number[s]) & (role == r), F.lit(number[to])).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss flag) per conversation."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def segments(t):
        trained = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(template.before), escape_role(t["role"]), F.lit(template.between)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), trained.alias("loss")),
            F.struct(F.lit(template.after).alias("text"), F.lit(False).alias("loss")))

    states = template.states
    after = F.array(*[F.aggregate("t", F.lit(i), lambda s, t: _step(template, s, t["role"])) for i in range(len(states))])
    blocks = blocks.select("conv_id", "block", F.size("t").cast("long").alias("n"), after.alias("after"),
                           F.flatten(F.transform("t", segments)).alias("segments"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n", "after", "segments"))).alias("b"))
    last = F.aggregate("b", F.lit(states.index(template.start)),
                       lambda s, b: F.when(s < 0, s).otherwise(F.element_at(b["after"], s + 1)))
    return whole.select(
        "conv_id", F.aggregate("b", F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("n_turns"),
        last.isin(*[states.index(s) for s in template.accepting]).alias("valid"),
        F.flatten(F.transform("b", lambda b: b["segments"])).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Formatted text -> array of (role, text)."""
    parts = F.split(text, f"\\Q{template.after}\\E", -1)
    body = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                       lambda p: F.substr(p, F.lit(len(template.before) + 1)))

    def turn(p):
        role = F.substring_index(p, template.between, 1)
        rest = F.substr(p, F.char_length(role) + F.lit(len(template.between) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(body, turn)


def digest(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """The formatted chats read back: turns and trained text as digests."""
    read = chats.select("conv_id", "valid", formatted(F.col("segments")).alias("all"),
                        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    turns = read.withColumn("turns", read_back(F.col("all"), template))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(F.array_join(F.transform("turns", line), "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
        F.char_length("all").cast("long").alias("formatted_chars"), "valid")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that quotes the control signs."""
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(format_chats(turns.unionByName(probe)))


ORACLE = {"op1_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
marked AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    12 + 1 + 11 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))
      + length(replace(replace(replace(role, '\\', '\\s'), chr(10), '\\n'), '<|', '<\\p')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                WHEN before IN ('system', 'assistant') THEN role = 'user'
                WHEN before = 'user' THEN role = 'assistant' ELSE false END
           AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id
"""}
