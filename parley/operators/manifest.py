"""Training plans and manifests as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.constants import constant_table
from parley.operators.recommend import ALTERNATIVES_SHOWN, DEFAULT_TARGET, DEFAULT_TASK, MODELS, REQUEST

# Fallbacks of the plan and the manifest.
FALLBACK_MODEL_ID = "microsoft/Phi-4-mini-instruct"
FALLBACK_MODEL_NAME = "Phi-4 Mini"
OUTPUT_DIR = "./lora_adapter"
DATA_PATH = "./data.jsonl"
MAX_SEQ_LENGTH = 2048
LORA_R, LORA_ALPHA, LORA_DROPOUT = 16, 16, 0
# Modules that an adapter trains.
ATTENTION_MODULES = ["q_proj", "k_proj", "v_proj", "o_proj"]
PHI_MODULES = [*ATTENTION_MODULES, "fc1", "fc2"]
OTHER_MODULES = [*ATTENTION_MODULES, "gate_proj", "up_proj", "down_proj"]
# Name parts of models that ask for consent.
GATED_PATTERNS = [
    "meta-llama", "llama-2", "llama-3", "llama2", "llama3", "google/gemma", "gemma-2",
    "mistralai/mistral", "mistralai/mixtral", "bigscience/bloom", "tiiuae/falcon",
]
# Minutes per hundred examples and epoch, by model size.
MINUTES_BY_SIZE = [("2B", 1.0), ("3B", 1.5), ("3.8B", 2.0), ("7B", 4.0), ("8B", 5.0)]
MINUTES_OTHERWISE = 2.0

_TRAINING_ARGS = (
    "STRUCT<num_train_epochs: INT, per_device_train_batch_size: INT, gradient_accumulation_steps: INT, "
    "learning_rate: DOUBLE, fp16: BOOLEAN, logging_steps: INT, save_strategy: STRING, "
    "warmup_ratio: DOUBLE, warmup_steps: INT, weight_decay: DOUBLE>"
)


def planned_training_args() -> Column:
    # Arguments a plan sets.
    return F.struct(
        F.lit(3), F.lit(4), F.lit(4), F.lit(2e-4), F.lit(True), F.lit(10), F.lit("epoch"), F.lit(0.1),
        F.lit(None), F.lit(None),
    ).cast(_TRAINING_ARGS)


def default_training_args() -> Column:
    # Arguments of a manifest whose plan sets none.
    return F.struct(
        F.lit(3), F.lit(2), F.lit(4), F.lit(2e-4), F.lit(None), F.lit(10), F.lit(None), F.lit(None),
        F.lit(5), F.lit(0.01),
    ).cast(_TRAINING_ARGS)


def target_modules(model_id: Column) -> Column:
    phi, other = (F.array(*map(F.lit, names)) for names in (PHI_MODULES, OTHER_MODULES))
    return F.when(F.contains(F.lower(model_id), F.lit("phi")), phi).otherwise(other)


def is_gated(model_id: Column) -> Column:
    return F.exists(
        F.array(*map(F.lit, GATED_PATTERNS)), lambda p: F.contains(F.lower(model_id), p)
    )


def training_minutes(n: Column, size: Column) -> Column:
    base = F.create_map(*[F.lit(x) for item in MINUTES_BY_SIZE for x in item])
    minutes = F.coalesce(base[size], F.lit(MINUTES_OTHERWISE))
    return minutes * (n.cast("double") / 100) * 3


def training_time(minutes: Column) -> Column:
    return (
        F.when(minutes < 5, "~5 minutes")
        .when(minutes < 30, F.format_string("~%d minutes", F.floor(minutes)))
        .otherwise(F.format_string("~%.1f hours", T.round_one_decimal(minutes / 60)))
    )


def training_plans(ranked: DataFrame) -> DataFrame:
    """One plan per request, from the ranked models of each.

    A ``selected_model_id`` asked for with the request overrides the winner. The display name follows
    the selection only when it is one of the alternatives shown.
    """
    selected = F.col("selected_model_id")
    # The winner's row knows the models shown beside it.
    plans = ranked.where(F.col("rank") == 1)
    others = F.slice("shown", 2, ALTERNATIVES_SHOWN)
    chosen = F.filter(others, lambda m: m["model_id"] == selected)
    name = F.coalesce(F.get(chosen, 0)["model_name"], "model_name", F.lit(FALLBACK_MODEL_NAME))
    task = F.coalesce("user_task", F.lit(DEFAULT_TASK))
    target = F.coalesce("target", F.lit(DEFAULT_TARGET))
    return plans.select(
        *REQUEST,
        "request_id",
        "num_examples",
        F.coalesce(F.nullif(selected, F.lit("")), "model_id", F.lit(FALLBACK_MODEL_ID)).alias("base_model"),
        name.alias("model_name"),
        F.format_string(
            "Based on your %s task and %s deployment target, we recommend %s.", task, target, name
        ).alias("reasoning"),
        planned_training_args().alias("training_args"),
    )


def training_manifests(plans: DataFrame) -> DataFrame:
    """Plans completed with every default a training run needs.

    ``plans`` needs ``base_model`` and ``num_examples``; ``data_path``, ``output_dir``, ``max_seq_length``,
    ``lora_config`` and ``training_args`` are kept where present and filled where missing or NULL.
    """
    model = F.col("base_model")

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in plans.columns else default

    lora = F.struct(
        F.lit(LORA_R).alias("r"),
        F.lit(LORA_ALPHA).alias("lora_alpha"),
        F.lit(LORA_DROPOUT).alias("lora_dropout"),
        target_modules(model).alias("target_modules"),
    )
    sizes = constant_table(
        plans.sparkSession, ["base_model", "model_size"], [(m[1], m[3]) for m in MODELS]
    )
    carried = [c for c in [*REQUEST, "request_id", "model_name", "reasoning"] if c in plans.columns]
    minutes = training_minutes(F.col("num_examples"), F.col("model_size"))
    return plans.join(sizes, "base_model", "left").select(
        *carried,
        "num_examples",
        "base_model",
        given("data_path", F.lit(DATA_PATH)).alias("data_path"),
        given("output_dir", F.lit(OUTPUT_DIR)).alias("output_dir"),
        given("max_seq_length", F.lit(MAX_SEQ_LENGTH)).alias("max_seq_length"),
        given("lora_config", lora).alias("lora_config"),
        given("training_args", default_training_args()).alias("training_args"),
        is_gated(model).alias("is_gated"),
        training_time(minutes).alias("estimated_time"),
    )


def config_json(manifests: DataFrame) -> DataFrame:
    """The manifest of each dataset as one JSON text."""
    config = F.struct(
        "base_model", "data_path", "output_dir", "max_seq_length", "lora_config", "training_args"
    )
    return manifests.select("dataset_id", F.to_json(config).alias("config"))
