"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, folded into blocks of adjacent turns
of one role by one array aggregation, and concatenated. Marker strings that occur inside a text are
escaped, reversibly: a backslash becomes two, and the first character of a marker becomes a
backslash and a letter, so a formatted text holds a marker only where the template put it. Rows
are gathered by conversation in one shuffle; a conversation is one output row, so its length is
bounded by a row, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import hex_sha256, table, text_or_empty

#: The template. A block is OPEN role NEWLINE text (JOIN text)* CLOSE.
OPEN, JOIN, CLOSE = "<|turn|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"
#: Marker strings of this and of other public chat templates; none survives inside a text.
CONTROL = (
    OPEN, JOIN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>",
    "<|end_header_id|>",
)


def _tails(first: str) -> str:
    special = set("|[]()\\.*+?^$")
    tails = [c[1:] for c in CONTROL if c[0] == first]
    return "|".join("".join("\\" + x if x in special else x for x in t) for t in tails)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, f"<(?={_tails('<')})", "\\\\l")
    return F.regexp_replace(out, f"\\[(?={_tails('[')})", "\\\\b")


def unescape(text: Column) -> Column:
    parts = F.transform(
        F.split(text, "\\\\\\\\"),
        lambda x: F.replace(
            F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")
        ),
    )
    return F.array_join(parts, "\\")


def escape_role(role: Column) -> Column:
    """A role is one line: its line ends become a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(
        F.split(role, "\\\\\\\\"),
        lambda x: F.replace(
            F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")),
            F.lit("\\n"), F.lit("\n"),
        ),
    )
    return F.array_join(parts, "\\")


def blocks_of(turns: Column) -> Column:
    """Adjacent turns of one role as one block: role and its texts in order.

    The array is cut where the role changes: the places of the changes are kept, and each block is
    the slice between two of them, so that nothing is copied twice.
    """
    starts = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]),
    )
    return F.flatten(
        F.transform(
            F.array(starts),
            lambda s: F.transform(
                s,
                lambda i, k: F.struct(
                    F.get(turns, i - 1)["role"].alias("role"),
                    F.transform(
                        F.slice(
                            turns, i, F.coalesce(F.get(s, k + 1), F.size(turns) + 1) - i
                        ),
                        lambda t: t["text"],
                    ).alias("texts"),
                ),
            ),
        )
    )


def format_chats(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length, in code
    points of ``formatted``; each covers one assistant text).

    Turns are ordered by ``turn``, null first; equal turns by role, then text, so repeated rows stay
    and have a defined order. Null text or role is empty. Rows with a null id are one conversation.
    Other columns are ignored; an empty table gives no rows.
    """
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                F.col(turn).alias("turn"),
                escape_role(text_or_empty(role)).alias("role"),
                escape(text_or_empty(text)).alias("text"),
            )
        )
    )
    gathered = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("__turns"))
    blocks = gathered.select("conv_id", blocks_of(F.col("__turns")).alias("__blocks"))
    pieces = F.transform(
        "__blocks",
        lambda b: F.struct(
            b["role"].alias("role"),
            b["texts"].alias("texts"),
            F.concat(F.lit(OPEN), b["role"], F.lit("\n")).alias("head"),
            F.concat(F.array_join(b["texts"], JOIN), F.lit(CLOSE)).alias("body"),
        ),
    )
    shaped = blocks.select("conv_id", pieces.alias("__pieces"))
    zero = F.lit(0).cast("bigint")
    # Folds the blocks once: the running length, and the spans of assistant texts.
    spans = F.aggregate(
        "__pieces",
        F.struct(zero.alias("at"), F.array().cast("array<array<struct<start:bigint,length:bigint>>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["role"] == ASSISTANT,
                F.array_append(acc["spans"], _spans(acc["at"] + F.length(p["head"]), p["texts"])),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: F.flatten(acc["spans"]),
    )
    joined = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return shaped.select("conv_id", joined.alias("formatted"), spans.alias("loss_spans"))


def _spans(start: Column, texts: Column) -> Column:
    """Spans of the texts of one block that begins at ``start``."""
    return F.aggregate(
        texts,
        F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) + len(JOIN)).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(acc["at"].alias("start"), F.length(t).cast("bigint").alias("length")),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) of each formatted text, as they were, and the texts under the mask."""
    blocks = F.filter(
        F.split("formatted", OPEN.replace("|", "\\|")), lambda b, i: i > 0
    )
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(
                    F.substring(
                        F.substring_index(b, CLOSE, 1),
                        F.length(F.substring_index(b, "\n", 1)) + 2,
                        F.length(b),
                    ),
                    JOIN.replace("|", "\\|"),
                ),
                lambda t: F.struct(
                    unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )
    masked = F.transform(
        "loss_spans",
        lambda s: unescape(
            F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
    return formatted.withColumns({"turns": turns, "masked": masked})


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM VALUES "
        f"(0, 'user', '{probe}'), (1, 'assistant', '{probe}') AS t(turn, role, text)"
    )
    back = read_chats(format_chats(rows.unionByName(extra)))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join("masked", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        hex_sha256(said).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        hex_sha256(loss).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _count(text: str, strings: tuple[str, ...]) -> str:
    """SQL that counts the strings in a text."""
    parts = [
        f"(length({text}) - length(replace({text}, '{s}', ''))) // {len(s)}" for s in strings
    ]
    return "(" + " + ".join(parts) + ")"


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false)
    AS joined, length(text) + {_count("text", ("\\",) + CONTROL)} AS n
  FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
      AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(n + CASE WHEN joined THEN {len(JOIN)}
                 ELSE {len(OPEN) + len(CLOSE) + 1} + length(role) END)::BIGINT AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars
FROM g
"""
