"""Dataset statistics, their warnings, and the estimates derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.constants import constant_table

# Suggested system prompts, by family, in the order they are offered.
PROMPT_TEMPLATES = [
    ("classify", 1, "Classification Specialist",
     "You are a classification model. Analyze inputs carefully and return the most appropriate category. Be consistent in your classifications and provide confident, direct responses."),
    ("classify", 2, "Multi-Label Classifier",
     "You are a multi-label classification assistant. Analyze the input and identify all applicable categories. Maintain consistency in your labeling and explain your reasoning when multiple categories apply."),
    ("qa", 1, "Knowledge Expert",
     "You are a knowledgeable assistant specializing in answering questions accurately. Provide clear, well-researched answers. If you're uncertain about something, acknowledge it. Include reasoning or sources when helpful."),
    ("qa", 2, "Technical Support",
     "You are a technical support specialist. When answering questions, first understand the user's problem, then provide step-by-step solutions. Be patient and ask clarifying questions when needed."),
    ("conversation", 1, "Friendly Assistant",
     "You are a friendly, conversational assistant. Engage naturally with users, maintain context throughout the conversation, and ask clarifying questions when needed. Be helpful while keeping responses concise."),
    ("conversation", 2, "Professional Consultant",
     "You are a professional consultant assistant. Maintain a courteous and professional tone. Provide thorough, well-structured responses and prioritize accuracy and clarity in all communications."),
    ("generation", 1, "Creative Writer",
     "You are a creative content writer. Generate engaging, well-structured content that captures attention. Adapt your writing style to match the requested tone and format. Be original and compelling."),
    ("generation", 2, "Technical Writer",
     "You are a technical writer. Create clear, precise, and well-organized content. Use appropriate technical terminology, provide step-by-step instructions when relevant, and ensure accuracy in all details."),
    ("general", 3, "General Purpose",
     "You are a helpful, accurate, and versatile assistant. Adapt your responses to the user's needs, provide clear explanations, and maintain a professional yet friendly tone."),
]


# The sums that the statistics of a dataset rest on; they merge by addition.
SUMS = (
    "total_examples", "total_messages", "chars", "single", "system", "with_system", "user", "assistant",
    "user_chars", "assistant_chars",
)


def ingest_sums(features: DataFrame) -> DataFrame:
    """:data:`SUMS` of each dataset: one hash aggregate over conversation features."""
    return features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.sum("n_messages").alias("total_messages"),
        F.sum("n_chars").alias("chars"),
        F.count_if("is_single_turn").alias("single"),
        F.sum("n_system").alias("system"),
        F.count_if("has_system").alias("with_system"),
        F.sum("n_user").alias("user"),
        F.sum("n_assistant").alias("assistant"),
        F.sum("user_chars").alias("user_chars"),
        F.sum("assistant_chars").alias("assistant_chars"),
    )


def merged_sums(sums: DataFrame, *more: str) -> DataFrame:
    """Sums of several parts as those of the whole."""
    return sums.groupBy("dataset_id").agg(*[F.sum(c).alias(c) for c in (*SUMS, *more)])


def stats_of_sums(sums: DataFrame, *carried: str) -> DataFrame:
    """Statistics from :func:`ingest_sums`, a projection."""
    n = F.col("total_examples")
    system_messages = F.col("system")

    def percent(part: Column) -> Column:
        return T.round_half_even(F.lit(100).cast("double") * part / n)

    zero = F.lit(0).cast("bigint")
    tokens = T.floor_div(F.col("chars"), 4)
    output = F.coalesce(T.floor_div(F.col("assistant_chars"), F.col("assistant")), zero)
    return sums.select(
        "dataset_id",
        *carried,
        "total_examples",
        "total_messages",
        T.round_one_decimal(T.safe_ratio(F.col("total_messages"), n)).alias("avg_messages_per_example"),
        tokens.alias("total_tokens"),
        T.floor_div(tokens, n).alias("avg_tokens_per_example"),
        percent(F.col("single")).alias("single_turn_pct"),
        percent(n - F.col("single")).alias("multi_turn_pct"),
        (system_messages > 0).alias("has_system_prompts"),
        percent(system_messages).alias("system_prompt_pct"),
        percent(F.col("with_system")).alias("system_conv_pct"),
        F.coalesce(T.floor_div(F.col("user_chars"), F.col("user")), zero).alias("avg_input_chars"),
        output.alias("avg_output_chars"),
        F.when((n >= 500) & (output > 50), "excellent")
        .when(n >= 100, "good")
        .otherwise("minimal")
        .alias("quality"),
    )


def ingest_stats(features: DataFrame) -> DataFrame:
    """One row of statistics per dataset."""
    return stats_of_sums(ingest_sums(features))


def stats_rollup(features: DataFrame) -> DataFrame:
    """:func:`ingest_stats` of each dataset and, with ``is_overall``, of all of them together.

    Conversations go through one aggregate; the row of the whole adds up the sums of the datasets, so
    its averages are those of all conversations.
    """
    sums = ingest_sums(features).rollup("dataset_id")
    whole = (F.grouping("dataset_id") == 1).alias("is_overall")
    return stats_of_sums(sums.agg(whole, *[F.sum(c).alias(c) for c in SUMS]), "is_overall")


def warnings(stats: DataFrame) -> Column:
    """The warnings of a statistics row, in order, as an array."""
    n = stats["total_examples"]
    # Warning texts.
    found = F.array(
        F.when(stats["avg_tokens_per_example"] > 2000, "Long conversations may require truncation"),
        F.when(n < 100, "More examples recommended for better results"),
        F.when(
            ~stats["has_system_prompts"] & (n > 100),
            "Consider adding system prompts for better control",
        ),
    )
    return F.filter(found, lambda w: w.isNotNull())


def dataset_warnings(stats: DataFrame) -> DataFrame:
    """One row per warning."""
    return stats.select(
        "dataset_id", F.posexplode(warnings(stats)).alias("warning_no", "warning")
    ).withColumn("warning_no", (F.col("warning_no") + 1).cast("bigint"))


def training_estimates(stats: DataFrame) -> DataFrame:
    """Response tokens, the training-time band and whether to offer a system prompt."""
    n = stats["total_examples"]
    minutes = F.greatest(F.lit(5), T.round_half_up(n.cast("double") / 50))
    return stats.select(
        "dataset_id",
        "total_examples",
        T.round_half_up(stats["avg_output_chars"].cast("double") / 4).alias("avg_response_tokens"),
        F.when(minutes > 30, "25-35")
        .when(minutes > 15, "15-25")
        .otherwise(F.concat_ws("-", minutes, minutes + 5))
        .alias("training_minutes"),
        (~stats["has_system_prompts"] & (n >= 50)).alias("offer_system_prompt"),
    )


def prompt_family(stats: DataFrame) -> DataFrame:
    """The family of system prompts that fits the dataset."""
    chars = stats["avg_output_chars"]
    tokens = T.round_half_up(F.when(chars == 0, 200).otherwise(chars).cast("double") / 4)
    return stats.select(
        "dataset_id",
        F.when(tokens < 50, "classify")
        .when(stats["multi_turn_pct"] > 50, "conversation")
        .when(tokens > 200, "generation")
        .otherwise("qa")
        .alias("family"),
    )


def prompt_suggestions(stats: DataFrame) -> DataFrame:
    """The suggested prompts of each dataset: its family's two and a general one."""
    templates = constant_table(
        stats.sparkSession, ["family", "suggestion_no", "label", "prompt"], PROMPT_TEMPLATES
    )
    families = prompt_family(stats).select(
        "dataset_id", F.explode(F.array("family", F.lit("general"))).alias("family")
    )
    return families.join(templates, "family").select(
        "dataset_id", F.col("suggestion_no").cast("bigint"), "family", "label", "prompt"
    )
