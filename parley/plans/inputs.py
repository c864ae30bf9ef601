"""The given tables as chat and message tables, and inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASETS = 4


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as ``messages``, spread over four datasets by conversation."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.format_string("chat-%d", F.pmod("conv_id", F.lit(DATASETS))).alias("dataset_id"),
        "conv_id",
        "turn",
        "role",
        "text",
    )


def document_chats(spark: SparkSession, sf_dir: str, *datasets: str) -> DataFrame:
    """Every document as a two-message conversation: its language asks, its text answers.

    Each column named in ``datasets`` (``lang`` unless given, ``source``) groups all documents into
    datasets once; the table is read once for all of them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [F.concat(F.lit(f"{by}-"), by) for by in datasets or ("lang",)]

    def message(role: str, column: str):
        return F.struct(F.lit(role).alias("role"), F.col(column).alias("content"))

    return docs.select(
        F.explode(F.array(*names)).alias("dataset_id"),
        F.col("doc_id").alias("conv_id"),
        F.array(message("user", "lang"), message("assistant", "text")).alias("messages"),
    )


def as_json_answers(messages: DataFrame, dataset_id: str = "json") -> DataFrame:
    """A copy of a message table whose answers are JSON objects, as one dataset."""
    answer = F.concat(F.lit('{"answer": "'), F.col("text"), F.lit('"}'))
    return messages.withColumns(
        {
            "dataset_id": F.lit(dataset_id),
            "text": F.when(F.col("role") == "assistant", answer).otherwise(F.col("text")),
        }
    )


def broken_messages(messages: DataFrame) -> DataFrame:
    """The messages with faults by conversation - a wrong role, NULL and blank texts - and gaps between turns."""
    form = F.pmod("conv_id", F.lit(6))
    second = F.col("turn") == 1
    return messages.withColumns(
        {
            "role": F.when(second & (form == 0), "bot").when(second & (form == 1), F.lit(None)).otherwise(F.col("role")),
            "text": F.when(second & (form == 2), F.lit(None)).when(second & (form == 3), " \u3000").otherwise(F.col("text")),
            "turn": F.col("turn") * 3 + 5,
        }
    )


# Forms of a line, taken in turn by document; ``@`` stands for the text as a JSON string, ``#`` for its
# length, ``~`` for the bare text.
LINE_FORMS = [
    '{"messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": @}], "id": #}',
    "~",
    '{"messages": [{"role": "user", "content": @}]} tail',
    "[@]",
    "@",
    "null",
    '{"text": @}',
    '{"messages": @}',
    '{"messages": [{"role": "user", "content": @}]}',
    '{"messages": [@, @]}',
    '{"messages": [{"role": "user", "content": @}, {"content": @}]}',
    '{"messages": [{"role": "user", "content": @}, {"role": "assistant", "text": @}]}',
    '{"messages": [{"role": "user", "content": @}, {"role": "bot", "content": @}]}',
    '{"messages": [{"role": "user", "content": #}, {"role": "assistant", "content": @}]}',
    '{"messages": [{"role": "user", "content": @}, {"role": "assistant", "content": " \\u3000"}]}',
    '{"messages": [{"role": "assistant", "content": @}, {"role": "assistant", "content": "b"}]}',
    '{"messages": [{"role": "user", "content": @}, {"role": "system", "content": "s"}]}',
    '{"messages": [{"role": "system", "content": @}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}',
    # Cut, misquoted, and with signs too many or missing.
    '{"messages": [@, @',
    '{"messages": [@,]}',
    "{'messages': @}",
    '{"messages": @, "x": "cut',
    '{"messages" @}',
    '{"messages": @, "n": 01}',
    '{"messages": @, "x": "\\q"}',
]


# Those without bare text, which stay on one line whatever the text.
QUOTED_FORMS = [form for form in LINE_FORMS if form != "~"]


def document_lines(
    spark: SparkSession, sf_dir: str, forms: list[str] = LINE_FORMS, broken_every: int = 1
) -> DataFrame:
    """Every document as one line of JSONL, as ``dataset_id, line_no, line``.

    The forms follow each other by document id; with ``broken_every`` all but the documents whose id it
    divides have the first one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    turn = F.call_function("div", F.col("doc_id"), F.lit(broken_every))
    place = F.when(F.pmod("doc_id", F.lit(broken_every)) == 0, F.pmod(turn, F.lit(len(forms)))).otherwise(0)
    form = F.element_at(F.array(*map(F.lit, forms)), (place + 1).cast("int"))
    line = F.replace(form, F.lit("#"), F.length("text").cast("string"))
    line = F.when(form == "~", F.col("text")).otherwise(F.replace(line, F.lit("@"), quoted))
    return docs.select(
        F.concat(F.lit("lang-"), "lang").alias("dataset_id"),
        F.col("doc_id").alias("line_no"),
        line.alias("line"),
    )
