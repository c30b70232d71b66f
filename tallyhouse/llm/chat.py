"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn = "[INST]" text "[/INST]"  |  "<s>" text "</s>"  |  "<<SYS>>" text "<</SYS>>"
         | "<<SYS>>" role "[INST]" text "[/INST]"

for user, assistant, system and any other role. Blocks of a conversation are rendered as they
are and read again by a parser of this grammar, to which every control string is a mark; where
turns read back differ from the source, their contents are escaped and the block is rendered
and read again, until both are the same. Escaping puts one more backslash behind the bracket
of each control string that has any number of them, reading takes one away, so every text
comes back. A block that still differs with all its turns escaped raises.

Turns stand by turn number, then role, then text, nulls first. Null texts and roles are empty.
Repeated rows are turns of their own. A conversation is rendered in blocks of ``BLOCK_TURNS``
turn numbers, whose rows meet in one task; blocks begin and end between turns, so a
conversation's text is that of its blocks in order. The loss mask covers the texts of
assistant turns as they stand, escapes included. A null conversation id is a conversation. An
empty table has no blocks. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64

# The marks, and the same with the backslashes of escapes: fixed values of the template.
MARK = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>"
ESCAPES = [(r"<(\\*)(/?s>|</?SYS>>)", "<"), (r"\[(\\*)(/?INST\])", "[")]
ENDS = r"(?<=[\]>])(?<=\[/INST\]|</s>|<</SYS>>)"


def escaped(text: Column) -> Column:
    """One backslash more in each control string."""
    for pattern, bracket in ESCAPES:
        text = F.regexp_replace(text, pattern, rf"{bracket}$1\\$2")
    return text


def unescaped(text: Column) -> Column:
    """One backslash less in each control string that has some."""
    plain = text
    for pattern, bracket in ESCAPES:
        plain = F.regexp_replace(plain, pattern.replace(r"(\\*)", r"(\\*)\\"), rf"{bracket}$1$2")
    return F.when(F.contains(text, F.lit("\\")), plain).otherwise(text)


def rendered_turn(turn: Column, escape: Column) -> Column:
    """A turn in the template; its contents escaped where ``escape`` holds."""
    text = F.when(escape, escaped(turn.text)).otherwise(turn.text)
    role = F.when(escape, escaped(turn.role)).otherwise(turn.role)
    return (
        F.when(turn.role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(turn.role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .when(turn.role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), role, F.lit("[INST]"), text, F.lit("[/INST]")))
    )


def read_turn(piece: Column) -> Column:
    """(role, text, loss) of a rendered turn, cut at its marks, or null where the grammar has no such turn."""
    inner, after = F.get(piece.parts, F.lit(1)), F.get(piece.parts, F.lit(2))
    framed = (F.get(piece.parts, F.lit(0)) == "") & (F.element_at(piece.parts, -1) == "")

    def turn(role: Column, text: Column, loss: bool = False) -> Column:
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"), F.lit(loss).alias("loss"))

    return F.when(
        framed,
        F.when(piece.marks == "[INST] [/INST]", turn(F.lit("user"), inner))
        .when(piece.marks == "<s> </s>", turn(F.lit("assistant"), inner, True))
        .when(piece.marks == "<<SYS>> <</SYS>>", turn(F.lit("system"), inner))
        .when(piece.marks == "<<SYS>> [INST] [/INST]", turn(inner, after)),
    )


def cut_at_marks(piece: Column) -> Column:
    """The marks of a rendered turn, and what stands around them."""
    marks = F.concat_ws(" ", F.regexp_extract_all(piece, F.lit(MARK), F.lit(0)))
    return F.struct(marks.alias("marks"), F.split(piece, MARK, -1).alias("parts"))


def read(formatted: str | Column) -> Column:
    """The turns of a formatted text, as (role, text, loss); a null turn where it is against the grammar."""
    # Pieces end where turns end; behind the last end of a right text there is nothing.
    pieces = F.transform(F.split(formatted, ENDS, -1), cut_at_marks)
    left_over = F.struct(F.lit("").alias("marks"), F.array(F.lit("")).alias("parts"))
    return F.transform(F.filter(pieces, lambda p: ~p.eqNullSafe(left_over)), read_turn)


def formatted(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """(conv_id, block, n_turns, formatted, escapes, spans): rendered blocks that read back as their source.

    ``escapes`` says which turns are escaped, ``spans`` where the loss mask covers the block's
    text, as (start, length) in code points.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    blocks = (
        rows.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / block_turns).cast("long").alias("block"), turn.alias("t"))
        .groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    source = F.transform("turns", lambda t: F.struct(t.role, t.text, (t.role == "assistant").alias("loss")))

    def rendered(escapes: str) -> Column:
        return F.transform(F.arrays_zip(F.col("turns").alias("t"), F.col(escapes).alias("e")), lambda x: rendered_turn(x.t, x.e))

    def same(text: Column) -> Column:
        return read(text).eqNullSafe(source)

    never = F.transform("turns", lambda t: F.lit(False))
    always = F.transform("turns", lambda t: F.lit(True))
    # Turns that don't read back by themselves are the ones whose contents conflict.
    alone = F.transform(
        F.arrays_zip(F.col("turns").alias("t"), F.col("p0").alias("p")),
        lambda x: ~read(x.p).eqNullSafe(F.array(F.struct(x.t.role, x.t.text, (x.t.role == "assistant").alias("loss")))),
    )
    # Later renderings are only worked out where an earlier one differs.
    out = blocks.withColumn("e0", never).withColumn("p0", rendered("e0")).withColumn("ok0", same(F.concat_ws("", "p0")))
    out = out.withColumn("e1", F.when(F.col("ok0"), F.col("e0")).otherwise(alone))
    out = out.withColumn("p1", F.when(F.col("ok0"), F.col("p0")).otherwise(rendered("e1")))
    out = out.withColumn("ok1", F.col("ok0") | same(F.concat_ws("", "p1")))
    out = out.withColumn("e2", F.when(F.col("ok1"), F.col("e1")).otherwise(always))
    out = out.withColumn("p2", F.when(F.col("ok1"), F.col("p1")).otherwise(rendered("e2")))
    text = F.concat_ws("", "p2")
    checked = F.when(F.col("ok1") | same(text), text).otherwise(F.raise_error(F.lit("a block does not read back as its source")))
    lengths = F.transform("p2", lambda p: F.length(p))
    marked = F.arrays_zip(F.col("turns").alias("t"), F.col("p2").alias("p"), lengths.alias("n"), F.sequence(F.lit(0), F.size("p2") - 1).alias("i"))
    spans = F.transform(
        F.filter(marked, lambda x: x.t.role == "assistant"),
        lambda x: F.struct(
            (F.aggregate(F.slice(lengths, F.lit(1), x.i), F.lit(0), lambda s, n: s + n) + 3).alias("start"), (x.n - 7).alias("length")
        ),
    )
    return out.select(
        "conv_id", "block", F.size("turns").cast("long").alias("n_turns"), checked.alias("formatted"), F.col("e2").alias("escapes"), spans.alias("spans")
    )


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation what its formatted text reads back as: number and digest of turns, length and digest of the masked text.

    A digest is one pass over a conversation's whole text, so its blocks meet here; nothing
    but the formatted text is gathered.
    """
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "formatted"))).alias("b"))
    text = whole.select("conv_id", F.concat_ws("", "b.formatted").alias("formatted"))
    turns = text.withColumn("turns", read("formatted"))
    said = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    loss = F.transform(F.filter("turns", lambda t: t.loss), lambda t: t.text)
    return turns.withColumn("loss", F.concat_ws("", loss)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose two turns are nothing but marks of a template."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = conversations.sparkSession.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS v(conv_id, turn, role, text)"
    )
    return rows.unionByName(probe)


# The same digests from the source, and the template's length, in SQL.
SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>|</?SYS>>)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g')) AS n,
    length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>|</?SYS>>)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g')) AS r
  FROM rows),
said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE r + 20 END)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""
