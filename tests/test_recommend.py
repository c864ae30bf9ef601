from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from parley.operators import manifest, recommend as R

SCHEMA = (
    "dataset_id string, user_task string, target string, num_examples bigint, avg_response_length bigint, "
    "is_multilingual boolean, looks_like_json_output boolean, is_multi_turn boolean"
)


def ask(spark, *rows):
    return R.ranked_models(R.score_models(spark.createDataFrame(list(rows), SCHEMA)))


def view(spark, *row):
    r = R.recommendations(ask(spark, ("d", *row))).first()
    return r.primary_recommendation, r.alternatives, r.all_scores


def test_question_answering(spark):
    best, others, scores = view(spark, "qa", "not_sure", 1000, 528, False, False, True)
    assert scores == {R.LLAMA: 1.05, R.MISTRAL: 0.93, R.PHI: 0.68, R.QWEN: 0.66, R.GEMMA: 0.42}
    assert (best.model_name, best.score, best.confidence, best.context_window_formatted) == ("Llama 3.2 3B", 1.05, "high", "128K")
    assert best.reasons == [
        "Top performer for Q&A tasks", "Optimized for on-device deployment", "128K token context window",
        "Excellent at multi-turn context tracking", "Optimized for longer outputs",
    ]
    assert [(o.model_name, o.reasons) for o in others] == [
        ("Mistral 7B", ["Good alternative"]), ("Phi-4 Mini", ["~1 min faster training"]),
    ]


def test_tie_goes_to_the_task_order(spark):
    best, others, _ = view(spark, "generation", "not_sure", 1000, 300, False, False, False)
    assert (best.model_name, best.score) == ("Mistral 7B", 0.9)
    assert others[0].reasons == [
        "Close match (90/100)", "Requires HuggingFace approval (gated)", "~2 min faster training",
        "Lower VRAM (10GB vs 18GB)", "Larger context (128K tokens)",
    ]
    assert (others[1].model_name, others[1].score) == ("Qwen 2.5 3B", 0.6)
    assert others[1].reasons == ["~2 min faster training", "Lower VRAM (10GB vs 18GB)", "Larger context (32K tokens)"]


def test_multilingual_wins_over_edge_device(spark):
    best, others, scores = view(spark, "qa", "edge_device", 10, 10, True, True, True)
    assert best.model_name == "Qwen 2.5 3B" and scores == {R.QWEN: 1.0} and others == []
    assert best.reasons == ["Best multilingual support (29 languages)", "Optimized for non-English text"]


def test_edge_device(spark):
    best, others, scores = view(spark, "qa", "edge_device", 5000, 500, False, True, True)
    assert best.model_name == "Gemma 2 2B" and scores == {R.GEMMA: 1.0, R.PHI: 0.8}
    assert best.reasons == ["Smallest model (2B params)", "Optimized for low-power devices"]
    assert [(o.model_name, o.reasons) for o in others] == [("Phi-4 Mini", ["Good alternative"])]


def test_size_bounds(spark):
    at, *_ = view(spark, "conversation", "not_sure", 2000, 50, False, False, True)
    above, *_ = view(spark, "conversation", "not_sure", 2001, 50, False, False, True)
    assert at.score == above.score
    assert not any("Scales" in r for r in at.reasons)
    assert "Scales well with 2,001 examples" in above.reasons


def test_long_answers_hide_json_scores_but_not_the_json_reason(spark):
    _, _, at = view(spark, "classify", "not_sure", 1000, 200, False, True, False)
    best, _, above = view(spark, "classify", "not_sure", 1000, 201, False, True, False)
    assert (at[R.PHI], above[R.PHI]) == (0.95, 0.8)
    assert best.reasons[-1] == "Excellent JSON/structured output"


def test_defaults_for_missing_characteristics(spark):
    best, _, scores = view(spark, None, None, 600, None, None, None, None)
    assert best.model_name == "Phi-4 Mini" and scores[R.PHI] == 0.85


# Points as one small table per factor, in model order phi, gemma, llama, qwen, mistral.
ORDER = [R.PHI, R.GEMMA, R.LLAMA, R.QWEN, R.MISTRAL]
BY_TASK = {
    "classify": (50, 35, 30, 25, 20), "qa": (35, 20, 50, 30, 45), "conversation": (25, 20, 50, 35, 45),
    "generation": (20, 20, 45, 30, 50), "extraction": (50, 25, 40, 30, 35),
}
BY_SIZE = [(500, (20, 30, 10, 10, 5)), (2000, (25, 15, 30, 20, 20)), (float("inf"), (10, 5, 30, 10, 25))]
TIES = {
    "classify": "01243", "extraction": "02431", "qa": "24031", "conversation": "24301", "generation": "42301",
}


def expected(task, target, n, length, json_like, multi):
    models = range(5)
    if target in ("mobile_app", "ios_app", "android_app", "web_browser"):
        models = range(3)
    size = next(points for bound, points in BY_SIZE if n < bound)
    output = (5, 5, 15, 10, 20) if length > 200 else (20, 5, 15, 10, 10) if json_like else (10,) * 5
    bonus = (3, 2, 10, 6, 8) if multi else (0,) * 5
    total = {m: BY_TASK.get(task, BY_TASK["classify"])[m] + size[m] + output[m] + bonus[m] for m in models}
    tie = TIES.get(task, "42031")
    ranked = sorted(total, key=lambda m: (-total[m], tie.index(str(m))))
    return [(ORDER[m], total[m]) for m in ranked]


def test_whole_grid(spark):
    tasks, targets = [*BY_TASK, "other"], [*R.TARGETS, "edge_device", "unknown"]
    grid = itertools.product(tasks, targets, [499, 500, 1999, 2000, 2001], [200, 201], [False, True], [False, True], [False, True])
    rows = [(str(i), t, g, n, ln, ml, js, mt) for i, (t, g, n, ln, js, mt, ml) in enumerate(grid)]
    scored = R.score_models(spark.createDataFrame(rows, SCHEMA)).select("dataset_id", "rank", "model_key", "score")
    got = {}
    for r in scored.collect():
        got.setdefault(r.dataset_id, {})[r.rank] = (r.model_key, r.score)
    assert len(got) == len(rows)
    for i, task, target, n, length, multilingual, json_like, multi in rows:
        if multilingual:
            want = [(R.QWEN, 100)]
        elif target == "edge_device":
            want = [(R.GEMMA, 100), (R.PHI, 80)]
        else:
            want = expected(task, target, n, length, json_like, multi)
        assert [got[i][k] for k in sorted(got[i])] == want


def test_plan_and_manifest(spark):
    asked = [("a", "qa", "not_sure", 1000, 528, False, False, True)]
    rows = spark.createDataFrame(asked * 4, SCHEMA).withColumn("user_task", F.lit("qa"))
    ids = {None: "Llama 3.2 3B", "microsoft/Phi-4-mini-instruct": "Phi-4 Mini", "google/gemma-2-2b-it": "Llama 3.2 3B", "x/y": "Llama 3.2 3B"}
    requests = None
    for i, picked in enumerate(ids):
        one = rows.limit(1).withColumn("dataset_id", F.lit(str(i))).withColumn("selected_model_id", F.lit(picked).cast("string"))
        requests = one if requests is None else requests.unionByName(one)
    plans = manifest.training_plans(R.ranked_models(R.score_models(requests)))
    got = {r.dataset_id: r for r in manifest.training_manifests(plans).collect()}
    for i, (picked, name) in enumerate(ids.items()):
        r = got[str(i)]
        assert r.base_model == (picked or "meta-llama/Llama-3.2-3B-Instruct")
        assert r.model_name == name
        assert r.reasoning == f"Based on your qa task and not_sure deployment target, we recommend {name}."
        assert r.training_args.per_device_train_batch_size == 4 and r.training_args.warmup_ratio == 0.1
        assert r.lora_config.r == 16
    assert got["1"].lora_config.target_modules[-2:] == ["fc1", "fc2"]
    assert got["0"].lora_config.target_modules[-2:] == ["up_proj", "down_proj"]
    assert [got[str(i)].is_gated for i in range(4)] == [True, False, True, False]
    assert got["0"].estimated_time == "~0.8 hours" and got["3"].estimated_time == "~1.0 hours"
    assert got["2"].estimated_time == "~0.5 hours"


def test_equal_requests_are_requests_of_their_own(spark):
    asked = ("a", "qa", "not_sure", 1000, 528, False, False, True)
    rows = spark.createDataFrame([asked, asked], SCHEMA)
    picked = F.when(F.monotonically_increasing_id() % 2 == 0, "x/y").otherwise("u/v")
    ranked = R.ranked_models(R.score_models(rows.coalesce(1).withColumn("selected_model_id", picked)))
    assert sorted(r["rank"] for r in ranked.collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert R.primary_models(ranked).count() == 2 and R.alternative_models(ranked).count() == 4
    plans = manifest.training_plans(ranked)
    assert sorted(r.base_model for r in plans.collect()) == ["u/v", "x/y"]
    assert R.recommendations(ranked).count() == 2
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("n", "model", "text"),
    [(100, "google/gemma-2-2b-it", "~5 minutes"), (166, "google/gemma-2-2b-it", "~5 minutes"),
     (167, "google/gemma-2-2b-it", "~5 minutes"), (200, "google/gemma-2-2b-it", "~6 minutes"),
     (999, "google/gemma-2-2b-it", "~29 minutes"), (1000, "google/gemma-2-2b-it", "~0.5 hours"),
     (250, "mistralai/Mistral-7B-Instruct-v0.3", "~0.5 hours"), (100, "other", "~6 minutes")],
)
def test_time_estimate(spark, n, model, text):
    plans = spark.createDataFrame([("d", n, model)], "dataset_id string, num_examples bigint, base_model string")
    row = manifest.training_manifests(plans).first()
    assert row.estimated_time == text
    assert row.training_args.per_device_train_batch_size == 2 and row.training_args.weight_decay == 0.01


def test_manifest_keeps_what_a_plan_sets(spark):
    plans = spark.createDataFrame([("d", 10, "google/gemma-2-2b-it", "out", 512)],
                                  "dataset_id string, num_examples bigint, base_model string, output_dir string, max_seq_length int")
    row = manifest.training_manifests(plans).first()
    assert (row.output_dir, row.max_seq_length, row.data_path) == ("out", 512, "./data.jsonl")
    config = json.loads(manifest.config_json(manifest.training_manifests(plans.drop("output_dir"))).first().config)
    assert config["output_dir"] == "./lora_adapter"
    assert config["lora_config"]["target_modules"][0] == "q_proj"
    assert config["training_args"]["learning_rate"] == 2e-4 and "fp16" not in config["training_args"]
