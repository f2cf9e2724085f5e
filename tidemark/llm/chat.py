"""Chat formatting in Spark expressions only: no Python sees a row.

Output: `### role: ` before each run of turns of one role, every turn's text followed by `</turn>`. In roles and
texts a backslash becomes \\b, `</turn>` becomes \\t and `### ` becomes \\h (in roles also a colon \\c), so neither
control string can come from a text, and each backslash left begins an escape. Turns keep their own ends, so merging
neighbours of one role loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import table

HEAD, END, COLON = "### ", "</turn>", ": "
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(END), F.lit("\\t")), F.lit(HEAD), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit(HEAD)), F.lit("\\t"), F.lit(END)), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask of every conversation; mask is an array of start, length in code points and byte_start, byte_length, from 0.

    Turns go by turn number, null first; ties by role, then text. Null roles and texts count as empty. Rows with a
    null conv_id are one conversation. Equal rows are turns of their own; an empty table has no conversations. The
    mask holds the texts, as escaped, of assistant turns. Other columns are not read. Texts of any length are taken
    whole, and a conversation's cost is in proportion to its length, however many turns it has: places in the output
    are running sums over its rows, made before these are collected.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("before", F.lag("role").over(order)).withColumn("place", F.row_number().over(order))
    opens = F.col("before").isNull() | (F.col("before") != F.col("role"))
    head = F.when(opens, F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(COLON))).otherwise(F.lit(""))
    rows = rows.select("conv_id", "place", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    parts = ["place", "head", "body", "trained"]
    by_place = Window.partitionBy("conv_id").orderBy("place")
    for of, size, before in (("", F.char_length, "start"), ("byte_", F.octet_length, "byte_start")):
        length = size("body").cast("long")
        rows = rows.withColumn(of + "length", length).withColumn(before, F.sum(size("head") + length + len(END)).over(by_place) - length - len(END))
        parts += [before, of + "length"]
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    mask = F.transform(F.filter("parts", lambda x: x["trained"]), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "length", "byte_start", "byte_length")]))
    return rows.select("conv_id", joined.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), trained (text under the mask, unescaped) from conv_id, formatted, mask.

    The mask's texts are cut out by their bytes, which needs no walk through the characters before them.
    """
    quoted = lambda x: "\\Q" + x + "\\E"
    runs = F.split("formatted", quoted(HEAD), -1)

    def run_of(run: Column) -> Column:
        colon = F.instr(run, COLON)
        role = unescape(F.replace(F.substring(run, F.lit(1), colon - 1), F.lit("\\c"), F.lit(":")))
        texts = F.split(F.substring(run, colon + len(COLON), F.char_length(run)), quoted(END), -1)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    turns = F.flatten(F.transform(F.slice(runs, F.lit(2), F.size(runs)), run_of))
    # the bytes are bound to a variable of a lambda, else they would be made anew for every turn
    raw = F.array(F.col("formatted").cast("binary"))
    said = F.transform(raw, lambda r: F.transform("mask", lambda m: unescape(F.substring(r, (m["byte_start"] + 1).cast("int"), m["byte_length"].cast("int")).cast("string"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(said[0], "").alias("trained"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted conversations."""
    rows = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


#: The two rows of conversation -7 with the table's, then digests of what was said and the lengths of what is written.
ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: {END} ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: {END} ok'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), escaped AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '{END}', '\\t'), '{HEAD}', '\\h') AS body,
    replace(replace(replace(replace(role, '\\', '\\b'), '{END}', '\\t'), '{HEAD}', '\\h'), ':', '\\c') AS name
  FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length(body) + {len(END)} + CASE WHEN before IS NULL OR before <> role THEN {len(HEAD)} + length(name) + {len(COLON)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
