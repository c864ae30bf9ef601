"""Rank base models for many datasets at once.

``requests`` has one row per question asked: ``dataset_id, user_task, target`` and the dataset's
``num_examples, avg_response_length, is_multilingual, looks_like_json_output, is_multi_turn``; it may
name a ``selected_model_id`` and bring a ``request_id``, else it gets one: equal questions are
requests of their own.
The catalogue is one literal array, so scoring and ranking are a projection: no join, window or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T

REQUEST = ["dataset_id", "user_task", "target"]

PHI, GEMMA, LLAMA, QWEN, MISTRAL = (
    "phi-4-mini",
    "gemma-3-2b",
    "llama-3.2-3b",
    "qwen-2.5-3b",
    "mistral-7b",
)

# Model catalog and, per model, the scores for dataset size, output and many turns.
MODEL_COLUMNS = [
    "model_key", "model_id", "model_name", "size", "context_window", "train_minutes", "memory_gb",
    "small", "medium", "large", "long_output", "json_output", "multi_turn_bonus",
]
MODELS = [
    (PHI, "microsoft/Phi-4-mini-instruct", "Phi-4 Mini", "3.8B", 128000, 3, 12, 20, 25, 10, 5, 20, 3),
    (GEMMA, "google/gemma-2-2b-it", "Gemma 2 2B", "2B", 8192, 2, 6, 30, 15, 5, 5, 5, 2),
    (LLAMA, "meta-llama/Llama-3.2-3B-Instruct", "Llama 3.2 3B", "3B", 128000, 4, 10, 10, 30, 30, 15, 15, 10),
    (QWEN, "Qwen/Qwen2.5-3B-Instruct", "Qwen 2.5 3B", "3B", 32768, 4, 10, 10, 20, 10, 10, 10, 6),
    (MISTRAL, "mistralai/Mistral-7B-Instruct-v0.3", "Mistral 7B", "7B", 8192, 6, 18, 5, 20, 25, 20, 10, 8),
]

# Models eligible per deployment target.
_ALL = (PHI, GEMMA, LLAMA, QWEN, MISTRAL)
_ON_DEVICE = (PHI, GEMMA, LLAMA)
TARGETS = {
    "cloud_api": _ALL,
    "desktop_app": _ALL,
    "mobile_app": _ON_DEVICE,
    "ios_app": _ON_DEVICE,
    "android_app": _ON_DEVICE,
    "web_browser": _ON_DEVICE,
    "not_sure": _ALL,
}
# Pools that skip scoring, with their scores.
MULTILINGUAL_POOL = {QWEN: 100}
EDGE_POOL = {GEMMA: 100, PHI: 80}

# Score per task and model.
TASK_SCORES = [
    ("classify", 50, 35, 30, 25, 20),
    ("qa", 35, 20, 50, 30, 45),
    ("conversation", 25, 20, 50, 35, 45),
    ("generation", 20, 20, 45, 30, 50),
    ("extraction", 50, 25, 40, 30, 35),
]
TASKS = [row[0] for row in TASK_SCORES]

# Which model wins a tie, per task.
TIE_ORDER = {
    "classify": (PHI, GEMMA, LLAMA, MISTRAL, QWEN),
    "extraction": (PHI, LLAMA, MISTRAL, QWEN, GEMMA),
    "qa": (LLAMA, MISTRAL, PHI, QWEN, GEMMA),
    "conversation": (LLAMA, MISTRAL, QWEN, PHI, GEMMA),
    "generation": (MISTRAL, LLAMA, QWEN, PHI, GEMMA),
    "default": (MISTRAL, LLAMA, PHI, QWEN, GEMMA),
}

# Why a model suits a task.
TASK_REASONS = [
    (PHI, "classify", "Best for classification tasks"),
    (GEMMA, "classify", "Fast and efficient for classification"),
    (PHI, "extraction", "Excellent at structured extraction"),
    (QWEN, "extraction", "Strong JSON/structured output"),
    (LLAMA, "qa", "Top performer for Q&A tasks"),
    (MISTRAL, "qa", "Strong reasoning and knowledge base"),
    (PHI, "qa", "Excellent reasoning capabilities"),
    (LLAMA, "conversation", "Best for conversational AI"),
    (MISTRAL, "conversation", "Natural dialogue and context tracking"),
    (QWEN, "conversation", "Multilingual conversation support"),
    (MISTRAL, "generation", "Best for long-form generation"),
    (LLAMA, "generation", "Creative and coherent text generation"),
    (QWEN, "generation", "Strong multilingual generation"),
]
# Defaults of the characteristics.
DEFAULT_TASK = "conversation"
DEFAULT_TARGET = "not_sure"
DEFAULT_RESPONSE_LENGTH = 50
REASONS_SHOWN = 5
ALTERNATIVES_SHOWN = 2


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def _catalogue() -> Column:
    """The models as an array, each with its scores per task, its place in ties and its pools.

    ``pools`` has the targets a model is eligible for; its value is the score of a pool that skips
    scoring, else -1.
    """
    pools = {**{t: dict.fromkeys(models, -1) for t, models in TARGETS.items()}}
    pools |= {"edge_device": EDGE_POOL, "multilingual": MULTILINGUAL_POOL}
    models = []
    for k, model in enumerate(MODELS):
        key = model[0]
        models.append(
            F.struct(
                *[F.lit(v).alias(c) for c, v in zip(MODEL_COLUMNS, model, strict=True)],
                _literal_map({t: scores[k] for t, *scores in TASK_SCORES}).alias("task_scores"),
                _literal_map({t: order.index(key) for t, order in TIE_ORDER.items()}).alias("priorities"),
                _literal_map({pool: found[key] for pool, found in pools.items() if key in found}).alias("pools"),
            )
        )
    return F.array(*models)


def recommendation_requests(
    profile: DataFrame, tasks: list[str], targets: list[str]
) -> DataFrame:
    """Ask every given task and target of every profiled dataset."""
    return (
        profile.withColumn("user_task", F.explode(F.array(*map(F.lit, tasks))))
        .withColumn("target", F.explode(F.array(*map(F.lit, targets))))
        .select(
            *REQUEST,
            "num_examples",
            "avg_response_length",
            "is_multilingual",
            "looks_like_json_output",
            "is_multi_turn",
        )
    )


def score_models(requests: DataFrame) -> DataFrame:
    """One row per request and eligible model with its points, score and rank."""
    n, length = F.col("num_examples"), F.col("avg_response_length")
    task, target = F.col("user_task"), F.col("target")
    asked = requests.withColumns(
        {
            "avg_response_length": F.coalesce(length, F.lit(DEFAULT_RESPONSE_LENGTH)),
            **{
                flag: F.coalesce(F.col(flag), F.lit(False))
                for flag in ("is_multilingual", "looks_like_json_output", "is_multi_turn")
            },
        }
    )
    if "selected_model_id" not in asked.columns:
        asked = asked.withColumn("selected_model_id", F.lit(None).cast("string"))
    if "request_id" not in asked.columns:
        asked = asked.withColumn("request_id", F.uuid())
    asked = asked.withColumns(
        {
            "pool": F.when(F.col("is_multilingual"), "multilingual")
            .when(target.isin("edge_device", *TARGETS), target)
            .otherwise(DEFAULT_TARGET),
            "score_task": F.when(task.isin(*TASKS), task).otherwise("classify"),
            "tie_task": F.when(task.isin(*TASKS), task).otherwise("default"),
        }
    )

    def scored(model: Column) -> Column:
        task_points = model["task_scores"][F.col("score_task")]
        size = F.when(n < 500, model["small"]).when(n >= 2000, model["large"]).otherwise(model["medium"])
        output = (
            F.when(length > 200, model["long_output"])
            .when(F.col("looks_like_json_output"), model["json_output"])
            .otherwise(10)
        )
        bonus = F.when(F.col("is_multi_turn"), model["multi_turn_bonus"]).otherwise(0)
        fixed = model["pools"][F.col("pool")]
        score = F.when(fixed >= 0, fixed).otherwise(task_points + size + output + bonus)
        # The first two fields order the models.
        return F.struct(
            (-score).alias("worst"),
            model["priorities"][F.col("tie_task")].alias("priority"),
            score.alias("score"),
            task_points.alias("task_points"),
            size.alias("size_points"),
            output.alias("output_points"),
            bonus.alias("bonus_points"),
            F.when(fixed >= 0, fixed).alias("fixed_score"),
            *[model[c].alias(c) for c in MODEL_COLUMNS[:7]],
        )

    eligible = F.filter(_catalogue(), lambda m: F.map_contains_key(m["pools"], F.col("pool")))
    ranked = asked.withColumn("models", F.array_sort(F.transform(eligible, scored)))
    first = F.col("models")[0]
    best = F.struct(*[first[c].alias(c) for c in ("score", "train_minutes", "memory_gb", "context_window")])
    # What a plan needs of the other models, so that nobody has to gather the rows of a request again.
    shown = F.transform(
        F.slice("models", 1, 1 + ALTERNATIVES_SHOWN),
        lambda m: F.struct(m["model_id"].alias("model_id"), m["model_name"].alias("model_name")),
    )
    return (
        ranked.select("*", best.alias("best"), shown.alias("shown"), F.posexplode("models").alias("at", "m"))
        .drop("models")
        .select("*", (F.col("at") + 1).alias("rank"), "m.*")
        .drop("at", "m", "worst", "priority")
    )


def confidence(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def context_label(tokens: Column) -> Column:
    return F.when(
        tokens >= 1000, F.concat(T.floor_div(tokens, 1000).cast("string"), F.lit("K"))
    ).otherwise(tokens.cast("string"))


def _present(reasons: list[Column]) -> Column:
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def primary_reasons(task_reason: Column) -> Column:
    """Reasons for the winner, at most five. ``task_reason`` is the looked-up text or NULL."""
    model = F.col("model_key")
    n, length = F.col("num_examples"), F.col("avg_response_length")
    # Reason texts, in the order they are given.
    scored = _present(
        [
            F.coalesce(task_reason, F.format_string("Strong performance for %s tasks", "user_task")),
            F.when(model.isin(PHI, MISTRAL), "Supports function calling"),
            F.when(model == QWEN, "Multilingual (29 languages)"),
            F.when(model.isin(GEMMA, LLAMA), "Optimized for on-device deployment"),
            F.when(model.isin(PHI, LLAMA), "128K token context window").when(
                model == QWEN, "32K token context window"
            ),
            F.when(
                F.col("is_multi_turn") & model.isin(LLAMA, MISTRAL),
                "Excellent at multi-turn context tracking",
            ),
            F.when((n < 500) & (model == GEMMA), "Ideal for small datasets")
            .when((n < 500) & (model == PHI), "Works well with limited data")
            .when(
                (n > 2000) & model.isin(LLAMA, MISTRAL),
                F.format_string("Scales well with %s examples", F.format_number(n, 0)),
            ),
            F.when((length > 200) & model.isin(LLAMA, MISTRAL), "Optimized for longer outputs").when(
                F.col("looks_like_json_output") & (model == PHI), "Excellent JSON/structured output"
            ),
            F.when(
                F.col("target").isin("mobile_app", "ios_app", "android_app") & model.isin(PHI, GEMMA),
                "Optimized for mobile deployment",
            ).when(
                (F.col("target") == "web_browser") & model.isin(PHI, GEMMA), "Runs efficiently in browser"
            ),
        ]
    )
    multilingual = ["Best multilingual support (29 languages)", "Optimized for non-English text"]
    edge = ["Smallest model (2B params)", "Optimized for low-power devices"]
    return (
        F.when(F.col("pool") == "multilingual", F.array(*map(F.lit, multilingual)))
        .when(F.col("pool") == "edge_device", F.array(*map(F.lit, edge)))
        .otherwise(F.slice(scored, 1, REASONS_SHOWN))
    )


def alternative_reasons() -> Column:
    """How an alternative compares with the winner."""
    model, best = F.col("model_key"), F.col("best")
    # Reason texts, in the order they are given.
    compared = _present(
        [
            F.when(
                F.col("score") >= best["score"] - 10, F.format_string("Close match (%d/100)", "score")
            ),
            F.when(model == LLAMA, "Requires HuggingFace approval (gated)").when(
                model == GEMMA, "Requires terms agreement (gated)"
            ),
            F.when(
                F.col("train_minutes") < best["train_minutes"],
                F.format_string("~%d min faster training", best["train_minutes"] - F.col("train_minutes")),
            ),
            F.when(
                F.col("memory_gb") < best["memory_gb"],
                F.format_string("Lower VRAM (%dGB vs %dGB)", "memory_gb", best["memory_gb"]),
            ),
            F.when(
                F.col("context_window") > best["context_window"],
                F.format_string(
                    "Larger context (%dK tokens)", T.floor_div(F.col("context_window"), 1000)
                ),
            ),
        ]
    )
    default = F.array(F.lit("Good alternative"))
    return F.when(
        (F.size(compared) == 0) | F.col("fixed_score").isNotNull(), default
    ).otherwise(compared)


_MODEL_VIEW = ["model_key", "model_id", "model_name", "size", "context_window"]


def ranked_models(scored: DataFrame) -> DataFrame:
    """``scored`` with the reasons of the primary (rank 1) and of the alternatives (ranks 2 and 3)."""
    texts = {f"{model} {task}": text for model, task, text in TASK_REASONS}
    task_reason = _literal_map(texts)[F.concat_ws(" ", "model_key", "user_task")]
    reasons = F.when(F.col("rank") == 1, primary_reasons(task_reason)).when(
        F.col("rank") <= 1 + ALTERNATIVES_SHOWN, alternative_reasons()
    )
    return scored.select(
        *REQUEST,
        "request_id",
        "rank",
        *_MODEL_VIEW,
        context_label(F.col("context_window")).alias("context_window_formatted"),
        (F.col("score").cast("double") / 100).alias("score"),
        confidence(F.col("score")).alias("confidence"),
        reasons.alias("reasons"),
        "num_examples",
        "selected_model_id",
        "shown",
    )


def primary_models(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") == 1).drop("rank", "shown")


def alternative_models(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank").between(2, 1 + ALTERNATIVES_SHOWN)).drop("confidence", "shown")


def recommendations(ranked: DataFrame) -> DataFrame:
    """One nested row per request: primary, alternatives in rank order, and all scores as a map."""
    model = F.struct(
        "model_id", "model_name", "size", "score", "confidence", "reasons", "context_window",
        "context_window_formatted",
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", model.alias("model"))))
    scores = F.map_from_entries(F.collect_list(F.struct("model_key", "score")))
    return (
        ranked.groupBy(*REQUEST, "request_id")
        .agg(ordered.alias("models"), scores.alias("all_scores"))
        .select(
            *REQUEST,
            "request_id",
            F.col("models")[0]["model"].alias("primary_recommendation"),
            F.transform(
                F.slice("models", 2, ALTERNATIVES_SHOWN),
                lambda m: m["model"].dropFields("confidence"),
            ).alias("alternatives"),
            "all_scores",
        )
    )
