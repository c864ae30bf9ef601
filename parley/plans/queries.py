"""The registered queries: every operator over whole tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame of scalar columns. Inputs are the
``conversations`` table spread over four datasets, and the ``documents`` table as two-message
conversations grouped by language or by source, which brings in duplicates, very short and very long
answers, non-ASCII text and datasets of different size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import conversation as C
from parley.functions import text as T
from parley.functions.lines import validate_lines
from parley.operators import dedup, manifest, profile, quality, recommend, rewrite, sketches, stats, training, validate
from parley.operators.features import (
    chat_features,
    conversation_features,
    message_facts,
    role_counts,
    token_budget,
    valid_only,
)
from parley.operators.ingest import ingest_jsonl
from parley.operators.running import RunningResults, ingest_new_files
from parley.operators.shape import explode_messages, nest_messages
from parley.plans.inputs import (
    QUOTED_FORMS,
    as_json_answers,
    broken_messages,
    conversation_messages,
    document_chats,
    document_lines,
)
from parley.schema import CONV_KEY, RESPONSE_SAMPLE, TOKEN_BUDGET
from parley.session import scratch_path, written_once
from parley.sources import jsonl, sinks
from parley.streaming import arrivals

SKETCH = 256  # answers in the sketch of a dataset
SYSTEM_PROMPT = "  You are a careful assistant.  "
ASKED_TASKS = [*recommend.TASKS, "summarise"]
ASKED_TARGETS = [*recommend.TARGETS, "edge_device", "toaster"]


# ---- inputs -------------------------------------------------------------------------------------


def all_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, and documents by language, as one message table."""
    docs = explode_messages(document_chats(spark, sf))
    return conversation_messages(spark, sf).unionByName(docs)


def all_chats(spark: SparkSession, sf: str) -> DataFrame:
    return nest_messages(conversation_messages(spark, sf)).unionByName(document_chats(spark, sf))


def many_messages(spark: SparkSession, sf: str) -> DataFrame:
    """``all_messages`` plus documents by source: datasets below, at and above the size bounds."""
    docs = explode_messages(document_chats(spark, sf, "lang", "source"))
    return conversation_messages(spark, sf).unionByName(docs)


def _features(messages: DataFrame) -> DataFrame:
    return conversation_features(message_facts(messages))


def _valid(messages: DataFrame) -> DataFrame:
    return valid_only(_features(messages))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ingest_stats(_valid(many_messages(spark, sf)))


def _profile(messages: DataFrame) -> DataFrame:
    return profile.dataset_profile(message_facts(messages))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every task and target asked of every dataset."""
    return recommend.recommendation_requests(
        _profile(many_messages(spark, sf)), ASKED_TASKS, ASKED_TARGETS
    )


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.ranked_models(recommend.score_models(_requests(spark, sf)))


# ---- features and statistics --------------------------------------------------------------------


def conv_features(spark, sf):
    return chat_features(all_chats(spark, sf))


def message_flags(spark, sf):
    text = F.col("text")
    answers = all_messages(spark, sf).where(F.col("role") == "assistant")
    return answers.select(
        *CONV_KEY,
        "turn",
        F.sha2(T.normalised(text), 256).alias("response_hash"),
        T.has_non_ascii(T.normalised(text)).alias("non_ascii"),
        T.looks_like_json(text).alias("json_like"),
        C.response_band(F.length(T.strip(text))).alias("band"),
    )


def role_count_rows(spark, sf):
    return role_counts(all_messages(spark, sf))


def ingest_stats(spark, sf):
    return _stats(spark, sf)


def conversation_stats(spark, sf):
    return stats.ingest_stats(_valid(conversation_messages(spark, sf)))


def dataset_warnings(spark, sf):
    return stats.dataset_warnings(_stats(spark, sf))


def training_estimates(spark, sf):
    return stats.training_estimates(_stats(spark, sf))


def prompt_family(spark, sf):
    return stats.prompt_family(_stats(spark, sf))


def prompt_suggestions(spark, sf):
    return stats.prompt_suggestions(_stats(spark, sf))


def token_budget_rows(spark, sf):
    return token_budget(_features(many_messages(spark, sf)), TOKEN_BUDGET)


# ---- quality and duplicates ---------------------------------------------------------------------


def quality_score(spark, sf):
    return quality.quality_score(_valid(many_messages(spark, sf)))


def quality_issues(spark, sf):
    return quality.quality_issues(quality.quality_score(_valid(many_messages(spark, sf))))


def duplicate_marks(spark, sf):
    return dedup.mark_duplicates(written_once(_features(all_messages(spark, sf)), "features"))


def dedup_conversations(spark, sf):
    messages = all_messages(spark, sf)
    return dedup.drop_duplicates(messages, _features(messages))


# ---- profile ------------------------------------------------------------------------------------


def dataset_profile(spark, sf):
    messages = many_messages(spark, sf)
    return _profile(messages.unionByName(as_json_answers(conversation_messages(spark, sf))))


def distinct_responses(spark, sf):
    facts = message_facts(many_messages(spark, sf))
    return profile.response_profile(facts).select(
        "dataset_id", "distinct_responses", "looks_like_classification"
    )


def sketched_flags(spark, sf):
    """The flags from sketches of two parts of each dataset, merged; a sketch that leaves it open counts again."""
    facts = written_once(message_facts(many_messages(spark, sf)), "facts")
    parts = [sketches.response_sketch(facts.where(F.pmod("conv_id", F.lit(2)) == k), SKETCH) for k in range(2)]
    merged = sketches.merged_sketches(parts[0].unionByName(parts[1]), SKETCH)
    return sketches.response_flags(merged, facts, SKETCH)


def multilingual_flag(spark, sf):
    facts = message_facts(many_messages(spark, sf))
    return profile.response_profile(facts).select(
        "dataset_id", "distinct_responses", "non_ascii_responses", "is_multilingual"
    )


def multilingual_flag_first_50(spark, sf):
    facts = message_facts(many_messages(spark, sf))
    return profile.response_profile(facts, RESPONSE_SAMPLE).select(
        "dataset_id", "distinct_responses", "non_ascii_responses", "is_multilingual"
    )


def _with_json_answers(spark: SparkSession, sf: str) -> DataFrame:
    messages = all_messages(spark, sf).unionByName(as_json_answers(conversation_messages(spark, sf)))
    return message_facts(messages)


def json_output_flag(spark, sf):
    return profile.json_profile(_with_json_answers(spark, sf))


def json_output_flag_first_50(spark, sf):
    return profile.json_profile(_with_json_answers(spark, sf), RESPONSE_SAMPLE)


# ---- validation ---------------------------------------------------------------------------------


def column_validation(spark, sf):
    return validate.validate_messages(all_messages(spark, sf))


def first_errors(spark, sf):
    return validate.first_errors(validate.validate_messages(all_messages(spark, sf)))


def broken_validation(spark, sf):
    """Every rule for roles and texts broken somewhere, in conversations whose turns have gaps."""
    return validate.validate_messages(broken_messages(all_messages(spark, sf)))


def broken_first_errors(spark, sf):
    return validate.first_errors(validate.validate_messages(broken_messages(all_messages(spark, sf))))


def broken_gate(spark, sf):
    return validate.dataset_gate(validate.validate_messages(broken_messages(all_messages(spark, sf))))


def dataset_gate(spark, sf):
    return validate.dataset_gate(validate.validate_messages(many_messages(spark, sf)))


def dataset_gate_quarantine(spark, sf):
    return validate.dataset_gate(validate.validate_messages(many_messages(spark, sf)), strict=False)


def accepted_conversations(spark, sf):
    verdicts = written_once(validate.validate_messages(many_messages(spark, sf)), "verdicts")
    rows = verdicts.select(*CONV_KEY, "n_messages")
    return validate.accepted_rows(rows, validate.dataset_gate(verdicts))


def rejected_datasets(spark, sf):
    verdicts = written_once(validate.validate_messages(many_messages(spark, sf)), "verdicts")
    return validate.rejected_datasets(verdicts, validate.dataset_gate(verdicts))


def line_validation(spark, sf):
    """Every document as a JSONL line, in turn valid or broken by one of the rules, parsed and judged.

    Of broken JSON the message has the parser's reason, and ``char_no`` the place.
    """
    return validate_lines(document_lines(spark, sf)).select(
        "dataset_id", "line_no", "error_code", "msg_idx", "char_no", "message"
    )


# ---- rows ---------------------------------------------------------------------------------------


def _conversations(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*CONV_KEY).agg(F.count(F.lit(1)).alias("n_messages"))


def preview_rows(spark, sf):
    messages = all_messages(spark, sf)
    return training.preview(messages, _conversations(messages))


def sample_page(spark, sf):
    return training.sample_page(_conversations(many_messages(spark, sf)))


def page_totals(spark, sf):
    return training.page_totals(_conversations(many_messages(spark, sf)))


def positional_sample(spark, sf):
    return training.positional_sample(_conversations(many_messages(spark, sf)))


# ---- recommendation and manifest ----------------------------------------------------------------


def recommend_scores(spark, sf):
    return recommend.score_models(_requests(spark, sf)).select(
        *recommend.REQUEST,
        "model_key",
        "task_points",
        "size_points",
        "output_points",
        "bonus_points",
        "score",
        F.col("rank").cast("bigint").alias("rank"),
    )


def _without_reasons(models: DataFrame) -> DataFrame:
    return models.drop("reasons", "num_examples", "selected_model_id", "request_id")


def recommend_primary(spark, sf):
    return _without_reasons(recommend.primary_models(_ranked(spark, sf)))


def recommend_alternatives(spark, sf):
    return _without_reasons(recommend.alternative_models(_ranked(spark, sf))).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def recommend_reasons(spark, sf):
    return (
        _ranked(spark, sf)
        .where(F.col("reasons").isNotNull())
        .select(
            *recommend.REQUEST,
            F.col("rank").cast("bigint").alias("rank"),
            "model_key",
            F.posexplode("reasons").alias("reason_no", "reason"),
        )
        .withColumn("reason_no", (F.col("reason_no") + 1).cast("bigint"))
    )


def recommend_all_scores(spark, sf):
    """The nested view, its score map spread over rows again."""
    return recommend.recommendations(_ranked(spark, sf)).select(
        *recommend.REQUEST,
        F.col("primary_recommendation.model_id").alias("primary_id"),
        F.size("alternatives").cast("bigint").alias("n_alternatives"),
        F.explode("all_scores").alias("model_key", "score"),
    )


def training_manifest(spark, sf):
    # Whoever asks for a phone has selected one fixed model, which is an alternative for some.
    picked = F.when(F.col("target") == "mobile_app", recommend.MODELS[0][1])
    asked = _requests(spark, sf).withColumn("selected_model_id", picked)
    ranked = recommend.ranked_models(recommend.score_models(asked))
    rows = manifest.training_manifests(manifest.training_plans(ranked))
    return rows.select(
        *recommend.REQUEST,
        "base_model",
        "model_name",
        "reasoning",
        "data_path",
        "output_dir",
        "max_seq_length",
        "lora_config.r",
        "lora_config.lora_alpha",
        "lora_config.lora_dropout",
        F.array_join("lora_config.target_modules", ",").alias("target_modules"),
        "training_args.num_train_epochs",
        "training_args.per_device_train_batch_size",
        "training_args.gradient_accumulation_steps",
        "training_args.learning_rate",
        "training_args.fp16",
        "training_args.logging_steps",
        "training_args.save_strategy",
        "training_args.warmup_ratio",
        "is_gated",
        "estimated_time",
    )


# ---- rewrites and training data -----------------------------------------------------------------


def add_system_prompt(spark, sf):
    return rewrite.add_system_prompt_rows(all_messages(spark, sf), SYSTEM_PROMPT)


def added_prompt_counts(spark, sf):
    return rewrite.modified_counts(rewrite.add_system_prompt(all_chats(spark, sf), SYSTEM_PROMPT))


def added_prompt_stats(spark, sf):
    rewritten = rewrite.add_system_prompt_rows(conversation_messages(spark, sf), SYSTEM_PROMPT)
    return stats.ingest_stats(_valid(rewritten))


def render_chat(spark, sf):
    return training.render_chats(all_chats(spark, sf))


def prompt_expected_pairs(spark, sf):
    return training.prompt_pairs_of_messages(all_messages(spark, sf))


def prompt_expected_pairs_nested(spark, sf):
    return training.prompt_pairs(all_chats(spark, sf))


def pair_snippets(spark, sf):
    return training.with_snippets(training.prompt_pairs_of_messages(all_messages(spark, sf)))


def generation_context(spark, sf):
    return training.context_before_answer(all_messages(spark, sf))


def generation_context_nested(spark, sf):
    chats = all_chats(spark, sf)
    context = chats.withColumn("messages", C.generation_context(F.col("messages")))
    return explode_messages(context)


def containment_accuracy(spark, sf):
    pairs = training.prompt_pairs_of_messages(all_messages(spark, sf))
    # Derived predictions: a third repeats the expected answer in lower case, the rest the prompt.
    repeats = F.pmod("conv_id", F.lit(3)) == 0
    predictions = pairs.select(
        *CONV_KEY,
        F.when(repeats, F.concat(F.lit("Answer: "), F.lower("expected"), F.lit(".")))
        .otherwise(F.col("prompt"))
        .alias("response"),
    )
    return training.containment_accuracy(pairs, predictions)


def first_system_prompt(spark, sf):
    return training.first_system_prompt(all_messages(spark, sf))


# ---- files --------------------------------------------------------------------------------------


def _written_jsonl(spark: SparkSession, chats: DataFrame, features: DataFrame) -> str:
    """Chats as training sets on shared storage; returns the reader's path of their data."""
    plans = features.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("num_examples")).withColumn(
        "base_model", F.lit(manifest.FALLBACK_MODEL_ID)
    )
    path = scratch_path(spark, "export")
    sinks.export_training_sets(chats, manifest.training_manifests(plans), path)
    return sinks.data_files(path)


def _conversation_files(spark: SparkSession, sf: str) -> str:
    messages = conversation_messages(spark, sf)
    return _written_jsonl(spark, nest_messages(messages), _conversations(messages))


def _line_features(chats: DataFrame) -> DataFrame:
    return chat_features(chats).select(
        "dataset_id", "conv_id", "n_messages", "n_user", "n_assistant", "n_system", "n_chars", "content_fingerprint"
    )


def jsonl_ingest(spark, sf):
    """Written as JSONL and read back file by file, with line numbers through all parts."""
    chats, _ = jsonl.read_jsonl(spark, _conversation_files(spark, sf), by="partition", suffix=".txt")
    return chat_features(chats).select(
        "dataset_id", "conv_id", "n_messages", "n_user", "n_assistant", "n_system", "n_chars", "content_fingerprint"
    )


def ingest_summary(spark, sf):
    """Files ingested in one operation: the verdict and the size of each dataset."""
    found = ingest_jsonl(spark, _conversation_files(spark, sf), by="partition", suffix=".txt")
    return found.gate.join(found.stats, "dataset_id", "left").select(
        "dataset_id", "n_valid", "n_errors", "accepted", "total_examples", "total_messages"
    )


def size_gate(spark, sf):
    """Files above a cap: one reject row each, and only then."""
    files = _conversation_files(spark, sf)
    outcomes = []
    for cap, max_bytes in (("none", None), ("one byte", 1)):
        _, rejects = jsonl.read_jsonl(spark, files, max_bytes, by="partition", suffix=".txt")
        listed = jsonl.list_files(spark, files, by="partition").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("files"))
        large = rejects.where("error_code = 'too_large'").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("refused"))
        rows = listed.join(large, "dataset_id", "left").select(
            "dataset_id",
            F.lit(cap).alias("cap"),
            (F.coalesce("refused", F.lit(0)) == F.when(F.lit(max_bytes is None), 0).otherwise(F.col("files"))).alias("as_told"),
        )
        outcomes.append(rows)
    return outcomes[0].unionByName(outcomes[1])


def file_gate(spark, sf):
    """Files of another suffix: a reject row for each dataset's files, and no conversation."""
    chats, rejects = jsonl.scan_jsonl(spark, _conversation_files(spark, sf), by="partition")
    kept = chats.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("kept"))
    refused = rejects.groupBy("dataset_id", "error_code", "message").agg(F.count(F.lit(1)).alias("files"))
    return refused.join(kept, "dataset_id", "left").select(
        "dataset_id", "error_code", "message", (F.col("files") > 0).alias("some"), F.coalesce("kept", F.lit(0)).alias("kept")
    )


def encoding_fallback(spark, sf):
    """Texts of the documents as bytes, in UTF-8 or Latin-1 by turns, decoded again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    latin = (F.pmod("doc_id", F.lit(2)) == 1) & ~F.col("text").rlike("[^\u0000-\u00ff]")
    content = F.when(latin, F.encode(F.regexp_replace("text", "[^\u0000-\u00ff]", "?"), "ISO-8859-1")).otherwise(
        F.encode("text", "UTF-8")
    )
    decoded = jsonl.decode(content)
    return docs.select("doc_id", F.length(decoded).cast("bigint").alias("n_chars"), F.sha2(decoded, 256).alias("text_hash"))


def jsonl_scan(spark, sf):
    """Written as JSONL and read back in splits, with line numbers through all parts."""
    chats, _ = jsonl.scan_jsonl(spark, _conversation_files(spark, sf), by="partition", suffix=".txt")
    return chat_features(chats).select(
        "dataset_id", F.col("conv_id").alias("line_no"), "n_messages", "n_chars", "content_fingerprint"
    )


def jsonl_rejects(spark, sf):
    _, rejects = jsonl.scan_jsonl(spark, _conversation_files(spark, sf), by="partition", suffix=".txt")
    return rejects.select("dataset_id", "line_no", "error_code", "msg_idx", "message")


def stream_ingest(spark, sf):
    """The same files as they arrive, in micro-batches."""
    out = scratch_path(spark, "arrived")
    query = arrivals.ingest_stream(
        spark,
        _conversation_files(spark, sf),
        out,
        scratch_path(spark, "stream-state"),
        by="partition",
        suffix=".txt",
        max_files=2,
    )
    query.awaitTermination()
    rows = written_once(_line_features(spark.read.parquet(f"{out}/chats")), "arrived")
    keys = rows.groupBy(*CONV_KEY).agg((F.count(F.lit(1)) == 1).alias("own_key"))
    return rows.join(keys, CONV_KEY).drop("conv_id")


def stream_first_arrivals(spark, sf):
    """Documents as arriving files; what is left after dropping what arrived before."""
    chats = document_chats(spark, sf)
    files = _written_jsonl(spark, chats, chats)
    out = scratch_path(spark, "first")
    arriving = arrivals.chat_stream(spark, files, by="partition", suffix=".txt", max_files=2)
    query = (
        arrivals.first_arrivals(arriving)
        .select("dataset_id", "content_fingerprint")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def _conversation_export(spark: SparkSession, sf: str) -> str:
    """The conversations as one published export beside one that was never finished."""
    messages = conversation_messages(spark, sf)
    plans = _conversations(messages).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("num_examples"))
    plans = plans.withColumn("base_model", F.lit(manifest.FALLBACK_MODEL_ID))
    path = scratch_path(spark, "export")
    half = sinks.json_lines(nest_messages(messages)).select("dataset_id", F.lit(sinks.DATA_FILE).alias("file"), "value")
    half.write.partitionBy("dataset_id", "file").text(f"{path}/sets/export=unfinished")
    sinks.export_training_sets(nest_messages(messages), manifest.training_manifests(plans), path)
    return path


def training_export(spark, sf):
    """The exported manifest of each dataset, parsed again, and the conversations beside it."""
    path = _conversation_export(spark, sf)
    configs, _ = sinks.read_training_sets(spark, path)
    data = sinks.published_files(spark, path).where(F.col("file") == sinks.DATA_FILE)
    lines = data.groupBy("dataset_id").agg(F.sum("n_rows").alias("n_rows"))
    parsed = F.from_json(
        "config",
        "base_model STRING, data_path STRING, output_dir STRING, max_seq_length INT, "
        "lora_config STRUCT<r: INT, lora_alpha: INT, lora_dropout: INT, target_modules: ARRAY<STRING>>, "
        "training_args STRUCT<num_train_epochs: INT, learning_rate: DOUBLE>",
    )
    rows = configs.select("dataset_id", parsed.alias("c"))
    return rows.join(lines, "dataset_id").select(
        "dataset_id",
        "c.base_model",
        "c.data_path",
        "c.output_dir",
        "c.max_seq_length",
        "c.lora_config.r",
        F.array_join("c.lora_config.target_modules", ",").alias("target_modules"),
        "c.training_args.num_train_epochs",
        "c.training_args.learning_rate",
        "n_rows",
    )


def export_commit(spark, sf):
    """What an export published of each file, and that it is all there is of it."""
    files = sinks.published_files(spark, _conversation_export(spark, sf))
    return files.groupBy("dataset_id", "file").agg(F.sum("n_rows").alias("n_rows"), (F.min("n_bytes") > 0).alias("has_text"))


# ---- running results ----------------------------------------------------------------------------


# At least so many ranges of lines, and so many more that a range holds about so many bytes of text.
_RANGES, _RANGE_BYTES = 6, 32 << 20


def _ranges(spark: SparkSession, sf: str) -> int:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(_RANGES, -(-total // _RANGE_BYTES))


def _line_files(spark: SparkSession, sf: str, ranges: int) -> str:
    """Documents by language as files of lines, most of them valid, some broken by turns."""
    docs = document_lines(spark, sf, QUOTED_FORMS, broken_every=40)
    path = scratch_path(spark, "line-files")
    rows = docs.repartitionByRange(ranges, "dataset_id", "line_no").sortWithinPartitions("dataset_id", "line_no")
    rows.select("dataset_id", F.col("line").alias("value")).write.partitionBy("dataset_id").text(path)
    return path


def _running(spark: SparkSession, sf: str) -> RunningResults:
    ranges = _ranges(spark, sf)
    files = _line_files(spark, sf, ranges)
    out = scratch_path(spark, "running")
    state = scratch_path(spark, "stream-state")
    # Four files a batch for the least number of ranges; more ranges make larger batches, not more of them.
    most = 4 * ranges // _RANGES
    query = arrivals.ingest_running(spark, files, out, state, by="partition", suffix=".txt", max_files=most, compact_every=3)
    query.awaitTermination()
    return RunningResults(spark, out)


def stream_statistics(spark, sf):
    """Statistics of datasets whose files arrive batch by batch."""
    return _running(spark, sf).statistics()


def stream_gate(spark, sf):
    """Verdicts on them, with the first errors by line number, whichever file came first."""
    return _running(spark, sf).gate()


def stream_kept(spark, sf):
    """The first by line number of conversations that are the same, over all batches."""
    kept = _running(spark, sf).kept()
    return kept.select("dataset_id", "line_no", F.size("messages").cast("bigint").alias("n_messages"))


def ingest_again(spark, sf):
    """Files taken in twice, the second time only what was added: verdict and size of each dataset."""
    files = _line_files(spark, sf, _ranges(spark, sf))
    out = scratch_path(spark, "running")
    for part in ("dataset_id=*[aeiou]?", "dataset_id=*"):
        results = ingest_new_files(spark, f"{files}/{part}", out, by="partition", suffix=".txt")
    gate = results.gate(strict=False)
    return gate.join(results.statistics(), "dataset_id", "left").select(
        "dataset_id", "n_valid", "n_errors", "accepted", "total_messages", "total_tokens"
    )


def stats_rollup(spark, sf):
    return stats.stats_rollup(_valid(many_messages(spark, sf)))


def quality_rollup(spark, sf):
    return quality.quality_score(_valid(many_messages(spark, sf)), overall=True)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "conv_features": conv_features,
        "message_flags": message_flags,
        "role_counts": role_count_rows,
        "ingest_stats": ingest_stats,
        "dataset_warnings": dataset_warnings,
        "training_time_band": training_estimates,
        "prompt_family": prompt_family,
        "prompt_suggestions": prompt_suggestions,
        "token_budget": token_budget_rows,
        "quality_score": quality_score,
        "quality_issues": quality_issues,
        "duplicate_marks": duplicate_marks,
        "dedup_conversations": dedup_conversations,
        "dataset_profile": dataset_profile,
        "distinct_responses": distinct_responses,
        "sketched_flags": sketched_flags,
        "multilingual_flag": multilingual_flag,
        "multilingual_flag_first_50": multilingual_flag_first_50,
        "json_output_flag": json_output_flag,
        "json_output_flag_first_50": json_output_flag_first_50,
        "column_validation": column_validation,
        "first_errors": first_errors,
        "broken_validation": broken_validation,
        "broken_first_errors": broken_first_errors,
        "broken_gate": broken_gate,
        "dataset_gate": dataset_gate,
        "dataset_gate_quarantine": dataset_gate_quarantine,
        "accepted_conversations": accepted_conversations,
        "rejected_datasets": rejected_datasets,
        "line_validation": line_validation,
        "preview_rows": preview_rows,
        "sample_page": sample_page,
        "page_totals": page_totals,
        "positional_sample": positional_sample,
        "recommend_scores": recommend_scores,
        "recommend_primary": recommend_primary,
        "recommend_alternatives": recommend_alternatives,
        "recommend_reasons": recommend_reasons,
        "recommend_all_scores": recommend_all_scores,
        "training_manifest": training_manifest,
        "add_system_prompt": add_system_prompt,
        "added_prompt_counts": added_prompt_counts,
        "added_prompt_stats": added_prompt_stats,
        "render_chat": render_chat,
        "prompt_expected_pairs": prompt_expected_pairs,
        "prompt_expected_pairs_nested": prompt_expected_pairs_nested,
        "pair_snippets": pair_snippets,
        "generation_context": generation_context,
        "generation_context_nested": generation_context_nested,
        "containment_accuracy": containment_accuracy,
        "first_system_prompt": first_system_prompt,
        "jsonl_ingest": jsonl_ingest,
        "ingest_summary": ingest_summary,
        "size_gate": size_gate,
        "file_gate": file_gate,
        "encoding_fallback": encoding_fallback,
        "jsonl_scan": jsonl_scan,
        "jsonl_rejects": jsonl_rejects,
        "stream_ingest": stream_ingest,
        "stream_first_arrivals": stream_first_arrivals,
        "training_export": training_export,
        "export_commit": export_commit,
        "stream_statistics": stream_statistics,
        "stream_gate": stream_gate,
        "stream_kept": stream_kept,
        "ingest_again": ingest_again,
        "stats_rollup": stats_rollup,
        "quality_rollup": quality_rollup,
    }
