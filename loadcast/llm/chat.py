"""Chat formatting by relational expressions alone.

The turns of a conversation are collected as structs, sorted, cut into runs of
one role, and written with marks around each run; strings of a text that look
like a mark are escaped, so that the turns can be read back exactly.  Every
step is a Spark expression that is linear in the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import table

# The template.  A run is opening mark, texts with TURN between them, closing mark.
BEGIN, END, TURN, NAMED = "<s>", "</s>", "[TURN]", "[TEXT]"
RUNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", END), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]")  # any other role: its name stands before NAMED
LOSS_ROLE = "assistant"

#: What follows the bracket that opens a mark.  A mark holds no second opening bracket and ends in its only closing one,
#: so neither two marks nor a mark and a text can overlap.
_TAIL = r"/?s>|/?INST\]|OUT\]|/?SYS\]|/?ROLE\]|TURN\]|TEXT\]"
ESCAPE = (rf"([<\[])(\\*)({_TAIL})", r"$1\\$2$3")     # one backslash more inside whatever reads like a mark
UNESCAPE = (rf"([<\[])\\(\\*)({_TAIL})", r"$1$2$3")   # one less


def escaped(text: Column) -> Column:
    """The text without any mark in it; ``unescaped`` gives it back."""
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _opening(role: Column) -> Column:
    marks = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(NAMED))
    for name, (mark, _) in RUNS.items():
        marks = F.when(role == name, F.lit(mark)).otherwise(marks)
    return marks


def _closing(role: Column) -> Column:
    marks = F.lit(OTHER[1])
    for name, (_, mark) in RUNS.items():
        marks = F.when(role == name, F.lit(mark)).otherwise(marks)
    return marks


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, n_runs, pieces).

    ``pieces`` is the formatted conversation as an array of (text, loss); the
    pieces one after another are the training text (``chat_text``), and those
    with ``loss`` are what the loss is taken over: the texts of assistant turns,
    a piece each, without marks.  Adjacent turns of one role share a run.

    A null text or role counts as empty.  Turns stand by number, null first;
    equal numbers by role, then text; repeated rows are turns of their own.
    Rows of a null conversation are one conversation.  Other columns are not
    read, whatever their names; an empty table gives no row.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # where a run starts: the first turn, and every turn whose role differs from the one before it
    starts = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]),
    )
    at = sorted_turns.withColumn("at", starts)
    runs = F.transform(
        F.col("at"), lambda s, k: F.slice("t", s + 1, F.coalesce(F.get("at", k + 1), F.size("t")) - s),
    )

    def piece(written: Column, loss: bool) -> Column:
        return F.struct(written.alias("text"), F.lit(loss).alias("loss"))

    def written(run: Column) -> Column:
        """A run's pieces: learned texts stand alone, the rest of the run is one piece."""
        own = F.element_at(run, 1)["role"]
        texts = F.transform(run, lambda t: escaped(t["text"]))
        between = F.transform(
            texts, lambda x, i: F.array(piece(F.when(i == 0, F.lit(RUNS[LOSS_ROLE][0])).otherwise(F.lit(TURN)), False), piece(x, True)),
        )
        learned = F.concat(F.flatten(between), F.array(piece(F.lit(RUNS[LOSS_ROLE][1]), False)))
        given = F.array(piece(F.concat(_opening(own), F.array_join(texts, TURN), _closing(own)), False))
        return F.when(own == LOSS_ROLE, learned).otherwise(given)

    return at.select(
        "conv_id", F.size("at").cast("long").alias("n_runs"),
        F.concat(F.array(piece(F.lit(BEGIN), False)), F.flatten(F.transform(runs, written))).alias("pieces"),
    )


def chat_text(pieces: str = "pieces") -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    runs = F.split(F.substring(formatted, len(BEGIN) + 1, 2_147_483_647), r"(?=\[INST\]|\[OUT\]|\[SYS\]|\[ROLE\])")

    def body(run: Column) -> Column:
        return F.regexp_replace(run, r"^(\[INST\]|\[OUT\]|\[SYS\]|\[ROLE\](?s:.*?)\[TEXT\])|(\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])$", "")

    def role(run: Column) -> Column:
        named = unescaped(F.regexp_extract(run, r"^\[ROLE\]((?s:.*?))\[TEXT\]", 1))
        for name, (mark, _) in RUNS.items():
            named = F.when(F.startswith(run, F.lit(mark)), F.lit(name)).otherwise(named)
        return named

    read = F.transform(runs, lambda run: F.struct(role(run).alias("role"), F.split(body(run), r"\[TURN\]").alias("texts")))
    turns = F.transform(
        read, lambda run: F.transform(run["texts"], lambda t: F.struct(run["role"].alias("role"), unescaped(t).alias("text"))),
    )
    return F.flatten(turns)


def read_loss(pieces: str = "pieces") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), "")


PLANTED = (-7, "</s>[INST] ok [/INST]")  # a conversation whose texts hold marks


def with_planted(conversations: DataFrame) -> DataFrame:
    """The rows and one conversation more: a user and an assistant who both say marks."""
    number, text = PLANTED
    planted = conversations.sparkSession.range(2).select(
        F.lit(number).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(text).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").union(planted)


def op12_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    chats = format_chats(with_planted(table(spark, root, "conversations", "conv_id", "turn", "role", "text")))
    read = chats.select("conv_id", "n_runs", chat_text().alias("formatted"), read_loss().alias("loss"))
    read = read.select("conv_id", "n_runs", "formatted", "loss", read_turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_runs",
    )


def op12_sql() -> str:
    """The digests of the turns as they are given, and the length of the formatted text from the template's lengths."""
    number, text = PLANTED
    marks = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in RUNS.items())

    def long(column: str) -> str:
        return f"length(regexp_replace({column}, '{ESCAPE[0]}', '\\1\\\\\\2\\3', 'g'))"

    return f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {number}, 0, 'user', '{text}' UNION ALL SELECT {number}, 1, 'assistant', '{text}'
    ), runs AS (
        SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens
        FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
        ({len(BEGIN)} + sum({long("text")} + CASE WHEN NOT opens THEN {len(TURN)} {marks}
            ELSE {len(OTHER[0]) + len(OTHER[1]) + len(NAMED)} + {long("role")} END))::BIGINT AS formatted_chars,
        sum(opens::INT)::BIGINT AS n_runs
    FROM runs GROUP BY conv_id
    """
