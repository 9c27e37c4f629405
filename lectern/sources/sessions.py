"""Session and conversation JSON into records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_DDL = "type string, message struct<role:string,id:string,model:string,content:array<struct<type:string,text:string>>>"
RECORD_DDL = "dataset string, row_index bigint, turn_index bigint, role string, model string, language string, text string, sha256 string"


def session_records(lines: DataFrame) -> DataFrame:
    """Assistant messages with exactly one visible text block.

    ``lines``: source_path, line_no (from 1), value (JSON). One row a message: source_path, session_id, message_id,
    jsonl_lines, text_block_index, text_line, model, text, sha256. Lines that are no JSON objects are left out.
    """
    x = lines.select("source_path", "line_no", F.from_json("value", LINE_DDL).alias("j")).where("j.type = 'assistant' and j.message.role = 'assistant' and j.message.id is not null")
    m = x.select("source_path", "line_no", "j.message.id", F.coalesce("j.message.model", F.lit("unknown")).alias("model"), F.filter(F.transform(F.coalesce("j.message.content", F.array().cast("array<struct<type:string,text:string>>")), lambda c, i: F.struct(i.alias("k"), c["type"].alias("type"), c["text"].alias("text"))), lambda c: c["type"] == "text").alias("texts"))
    g = m.groupBy("source_path", "id").agg(
        F.array_sort(F.collect_list("line_no")).alias("jsonl_lines"), F.sum(F.size("texts")).alias("n"),
        F.max(F.when(F.size("texts") > 0, F.struct("line_no", "model", F.try_element_at("texts", F.lit(1)).alias("t")))).alias("one"),
    ).where("n = 1 and one.model <> '<synthetic>'")
    return g.select(
        "source_path", F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("session_id"), F.col("id").alias("message_id"), "jsonl_lines", F.col("one.t.k").alias("text_block_index"), F.col("one.line_no").alias("text_line"),
        F.col("one.model").alias("model"), F.col("one.t.text").alias("text"), F.sha2("one.t.text", 256).alias("sha256"),
    )


def records_from_json(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Record fields of a JSON payload beside the other columns (prefixed ``rec_``); unreadable payloads give nulls."""
    j = F.from_json(payload, RECORD_DDL)
    return rows.withColumn("_j", j).select(*rows.columns, *(F.col(f"_j.{f.split()[0]}").alias(f"rec_{f.split()[0]}") for f in RECORD_DDL.split(", "))).drop("_j")


def conversation_turns(rows: DataFrame, conversation: str = "conversation", side: str | None = None) -> DataFrame:
    """One row a turn of an array of (role, content, ...): turn_index from 0, role, text."""
    out = rows.select(*(c for c in rows.columns if c != conversation), F.posexplode(conversation).alias("turn_index", "t"))
    return out.withColumns({"role": F.col("t.role"), "text": F.col("t.content"), "side": F.lit(side)}).drop("t")


TRAJECTORY_DDL = "type string, message struct<role:string,content:array<struct<type:string,text:string,name:string,input:struct<content:string,new_string:string,file_path:string>>>>"


def trajectory_texts(lines: DataFrame) -> DataFrame:
    """source_path, line_no, block_no, kind ('text' or the writing tool), file_path, text: what an agent wrote, by content block."""
    x = lines.select("source_path", "line_no", F.from_json("value", TRAJECTORY_DDL).alias("j")).where("j.message.role = 'assistant'")
    b = x.select("source_path", "line_no", F.posexplode("j.message.content").alias("block_no", "b"))
    text = F.when(F.col("b.type") == "text", F.col("b.text")).when((F.col("b.type") == "tool_use") & F.col("b.name").isin("Write", "Edit"), F.coalesce("b.input.content", "b.input.new_string"))
    return b.select("source_path", "line_no", "block_no", F.when(F.col("b.type") == "text", "text").otherwise(F.lower("b.name")).alias("kind"), F.col("b.input.file_path").alias("file_path"), text.alias("text")).where("text is not null")
