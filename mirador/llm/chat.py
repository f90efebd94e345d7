"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes one training example: all turns before it as context, and only
the reply under the loss mask. A turn is written as

    [INST]role[/INST]text</s>

with ``<s>`` before the first. Control strings inside roles and texts get a backslash after
their first character (and one more where some are there already), so none is left in a
text and the step back is exact: ``</s>`` <-> ``<\\/s>``, ``<\\/s>`` <-> ``<\\\\/s>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*(?:/?s>|/?INST\]))"
ESCAPED = r"([<\[])\\(\\*(?:/?s>|/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def expand(turns: DataFrame) -> DataFrame:
    """Examples of the turns (conv_id, turn, role, text), one row each.

    conv_id, example (from 0), trainable, formatted, loss_start and loss_chars (the mask, in
    characters of ``formatted``). A conversation that does not end with the assistant gets one
    more row, not trainable, with all turns and an empty mask, so that no turn is lost.
    Turns go by ``turn``, ties by role and text; repeated rows are turns of their own. Null
    roles and texts are empty; rows with a null conv_id form one conversation; a null turn
    comes first. Other columns are not looked at. A conversation is one row while it is
    formatted: the prefixes of its replies are what the method writes.
    """
    written = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    whole = (
        turns.select(
            "conv_id",
            F.struct(
                F.col("turn"),
                F.coalesce(F.col("role"), F.lit("")).alias("role"),
                F.coalesce(F.col("text"), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", written.alias("turns"))
    )
    last = F.size("turns")
    targets = F.filter(
        F.sequence(F.lit(1), last),
        lambda n: (F.element_at("turns", n)["role"] == "assistant") | (n == last),
    )
    example = whole.select("conv_id", "turns", F.posexplode(targets).alias("example", "upto"))
    context = F.concat(
        F.lit(BEGIN),
        F.array_join(
            F.transform(
                F.slice("turns", F.lit(1), F.col("upto") - 1),
                lambda t: F.concat(t["head"], t["body"], F.lit(END)),
            ),
            "",
        ),
        F.col("target.head"),
    )
    return (
        example.withColumn("target", F.element_at("turns", F.col("upto")))
        .select("conv_id", "example", "target", context.alias("context"))
        .select(
            "conv_id",
            "example",
            (F.col("target.role") == "assistant").alias("trainable"),
            F.concat("context", "target.body", F.lit(END)).alias("formatted"),
            F.length("context").alias("loss_start"),
            F.when(F.col("target.role") == "assistant", F.length("target.body")).otherwise(0).alias("loss_chars"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trained texts of each conversation, parsed from its formatted examples.

    conv_id, turns array<struct<role, text>>, trained array<string>, formatted_chars.
    """
    trained = F.when(
        F.col("trainable"), unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    )
    per_conversation = examples.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", trained.alias("text")))).alias("masks"),
        F.max_by("formatted", "example").alias("full"),
        F.sum(F.length("formatted").cast("bigint")).alias("formatted_chars"),
    )
    # cut by the unescaped control strings; what follows the last end is empty
    blocks = F.split(F.expr(f"substring(full, {len(BEGIN) + 1})"), END, -1)
    turns = F.transform(
        F.slice(blocks, F.lit(1), F.size(blocks) - 1),
        lambda b: F.struct(
            unescape(F.substring_index(F.substring(b, F.lit(len(OPEN) + 1), F.length(b)), CLOSE, 1)).alias("role"),
            unescape(F.substring(b, F.instr(b, CLOSE) + len(CLOSE), F.length(b))).alias("text"),
        ),
    )
    return per_conversation.select(
        "conv_id",
        turns.alias("turns"),
        F.transform(F.filter("masks", lambda m: m["text"].isNotNull()), lambda m: m["text"]).alias("trained"),
        "formatted_chars",
    )


ORACLE = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), w AS (
    SELECT *, 13 + length(regexp_replace(role, '([<\\[])(\\\\*(?:/?s>|/?INST\\]))', '\\1\\\\\\2', 'g'))
              + length(regexp_replace(text, '([<\\[])(\\\\*(?:/?s>|/?INST\\]))', '\\1\\\\\\2', 'g')) + 4 AS chars
    FROM t
), p AS (
    SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text
                                   ROWS UNBOUNDED PRECEDING) AS prefix_chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
    FROM w
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix_chars) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

SELF_TEST = "</s>[INST] ok [/INST]"


@query("op3_chat_formatting", ORACLE)
def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and a planted one full of control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SELF_TEST).alias("text"),
    )
    back = read_back(expand(turns.unionByName(planted)))
    joined = F.array_join("trained", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length(joined).cast("bigint").alias("loss_chars"),
        F.sha2(joined, 256).alias("loss_sha256"),
        "formatted_chars",
    )
