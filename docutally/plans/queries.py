"""One query per operator, each over the whole tables of a folder: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docutally import fixed_values as fv
from docutally.functions import subwords
from docutally.functions.text import is_blank, norm_number, norm_text, sha256_mod_10000, word_count
from docutally.operators import build, dataset, evaluate, evidence, profile, requestlog, training
from docutally.operators.clients import layout_reader
from docutally.operators.extract import (
    Model, add_cost, answer_error, apply_model, baseline_table, fixed_answer, outcomes, route, route_on_invalid,
)
from docutally.operators.prep import extraction_prompt, prompt_document, split_blank, training_example
from docutally.operators.validate import canonical_json, check_answers, record_json, record_label, strict_json
from docutally.plans import views
from docutally.session import cleaned, configure, fresh_path
from docutally.sources import jsonl
from docutally.sources import requestlog as log_files
from docutally.streaming import stream

DOC = ["doc_id"]
BY_MODEL = ["model", "doc_id"]
LATENCY = 0.01
PRICED_AS = {"large": "openai/gpt-oss-120b", "small": "invoice-small"}
#: Vocabulary file of the queries on real tokens.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"
REGISTRY: dict = {}


def query(function):
    """Register a query under its function name, without a ``_query`` ending."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    REGISTRY[function.__name__.removesuffix("_query")] = run
    return run


def _label_json(label: str = "invoice") -> Column:
    return F.to_json(label, {"ignoreNullFields": "false"})


def _day(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- scans, sources, sinks -----------------------------------------------------------
@query
def scan_pairs(spark, d):
    path = fresh_path(spark, "pairs")
    jsonl.write_pairs(views.pairs(spark, d), path)
    return jsonl.read_pairs(spark, path).select(
        "invoice.vendor_name",
        "invoice.invoice_number",
        "invoice.total_amount",
        F.size("invoice.line_items").cast("bigint").alias("n_items"),
        F.char_length("raw_text").cast("bigint").alias("n_chars"),
    )


@query
def scan_train(spark, d):
    path = fresh_path(spark, "train")
    jsonl.write_train(views.pairs(spark, d), path)
    return jsonl.read_train(spark, path).select(
        F.md5(prompt_document("prompt")).alias("document_md5"), F.md5("completion").alias("completion_md5")
    )


@query
def scan_documents(spark, d):
    # Whole files of 50 documents each, so that the number of files grows with the table.
    path = fresh_path(spark, "documents")
    folders = views.documents(spark, d).withColumn("folder", F.floor(F.col("doc_id") / 50))
    files = folders.repartition("folder").sortWithinPartitions("folder", "doc_id")
    files.select("folder", "raw_text").write.partitionBy("folder").text(path)
    return jsonl.read_documents(spark, path).select(
        F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("folder"),
        F.char_length("raw_text").cast("bigint").alias("n_chars"),
        F.md5("raw_text").alias("text_md5"),
    )


@query
def scan_request_log(spark, d):
    path = fresh_path(spark, "log")
    log_files.open_request_log(spark, path)
    log_files.append_outcomes(views.request_log(spark, d), path)
    return log_files.open_request_log(spark, path).select(
        "job_id", "model_name", "success", "error", "latency_seconds", "estimated_cost_usd",
        _day("created_at").alias("created_at"), F.col("created_date").cast("string").alias("created_date"),
    )


@query
def idempotent_append(spark, d):
    path = fresh_path(spark, "log")
    log = views.request_log(spark, d)
    retried = log.withColumns(
        {"model_name": F.lit("retry"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")}
    )
    log_files.append_outcomes(log.where("success").unionByName(retried.where("success")), path)
    log_files.append_outcomes(retried.unionByName(log), path)
    return log_files.open_request_log(spark, path).select(
        "job_id", "model_name", "success", _day("created_at").alias("created_at")
    )


@query
def log_stats(spark, d):
    """Statistics per model from the log's totals, after appends that repeat most jobs."""
    path = fresh_path(spark, "log")
    log = views.request_log(spark, d)
    log_files.append_outcomes(log.where("success"), path)
    log_files.append_outcomes(log, path)
    log_files.append_outcomes(log.where("NOT success"), path)
    return requestlog.stats_of_totals(log_files.totals(spark, path))


@query
def log_recent(spark, d):
    """The recent list from the newest days of the log."""
    path = fresh_path(spark, "log")
    log_files.append_outcomes(views.request_log(spark, d), path)
    newest = log_files.newest_days(spark, path, fv.RECENT_LIMIT)
    return requestlog.recent(newest).withColumn("created_at", _day("created_at"))


@query
def sink_roundtrip(spark, d):
    train, test = fresh_path(spark, "train"), fresh_path(spark, "test")
    jsonl.write_splits(views.pairs(spark, d), train, test, fv.TEST_SPLIT)
    trained = jsonl.read_train(spark, train).select(
        F.lit("train").alias("side"), F.md5(prompt_document("prompt")).alias("text_md5"), F.md5("completion").alias("label_md5")
    )
    tested = jsonl.read_pairs(spark, test).select(
        F.lit("test").alias("side"), F.md5("raw_text").alias("text_md5"), F.md5(_label_json()).alias("label_md5")
    )
    return trained.unionByName(tested)


@query
def append_history(spark, d):
    path = fresh_path(spark, "history")
    pairs = views.pairs(spark, d)
    urgent = F.col("dataset") == "1-URGENT"
    jsonl.write_pairs(pairs, path)
    jsonl.write_pairs(pairs.where(urgent), path, append=False)
    jsonl.write_pairs(pairs.where(~urgent), path, append=True)
    return jsonl.read_pairs(spark, path).groupBy(F.col("invoice.currency").alias("currency")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("raw_text")).alias("chars")
    )


# --- document preparation ------------------------------------------------------------
@query
def build_prompt(spark, d):
    prompt = extraction_prompt("raw_text")
    return views.documents(spark, d).select(
        "doc_id", F.char_length(prompt).cast("bigint").alias("prompt_chars"), F.md5(prompt).alias("prompt_md5")
    )


@query
def invert_prompt(spark, d):
    plain = F.col("doc_id") % 3 == 0
    prompt = F.when(plain, F.col("raw_text")).otherwise(extraction_prompt("raw_text"))
    return views.documents(spark, d).select("doc_id", F.md5(prompt_document(prompt)).alias("document_md5"))


@query
def reject_blank(spark, d):
    accepted, rejected = split_blank(views.submissions(spark, d))
    return accepted.select("doc_id", F.lit("accepted").alias("status")).unionByName(
        rejected.select("doc_id", F.lit("rejected").alias("status"))
    )


@query
def format_training(spark, d):
    return training_example(views.pairs(spark, d)).select("doc_id", F.md5("prompt").alias("prompt_md5"), "completion")


# --- extraction ----------------------------------------------------------------------
def _prompts(spark, d) -> DataFrame:
    return views.pairs(spark, d).select("doc_id", "raw_text").withColumn("prompt", extraction_prompt("raw_text"))


def _reader(name: str, layouts=range(dataset.N_LAYOUTS), careless=()) -> Model:
    return Model(name, layout_reader(layouts, careless, LATENCY))


@query
def apply_model_query(spark, d):
    checked = check_answers(apply_model(_prompts(spark, d), _reader("reader")))
    return checked.select("doc_id", "model_error", "valid", record_json("record").alias("invoice_json"))



@query
def fixed_client(spark, d):
    prompts = views.documents(spark, d).withColumn("prompt", extraction_prompt("raw_text"))
    checked = check_answers(fixed_answer(prompts))
    return checked.select(
        "doc_id", "input_tokens", "latency_seconds", "estimated_cost_usd", "valid", "record.vendor_name"
    )


@query
def route_fallback(spark, d):
    models = [_reader("primary", [0, 1, 2]), _reader("fallback", [0, 1, 2, 3])]
    return route(_prompts(spark, d), models).select(
        "doc_id", "model_used", "fallback_used", "model_error", "latency_seconds"
    )


@query
def route_on_invalid_query(spark, d):
    models = [_reader("primary", [0, 1, 2], careless=[1]), _reader("fallback")]
    return route_on_invalid(_prompts(spark, d), models).select(
        "doc_id", "model_used", "fallback_used", "valid", F.round("latency_seconds", 3).alias("latency_seconds")
    )



@query
def empty_output(spark, d):
    return views.model_output(spark, d).select("doc_id", answer_error("raw_output").alias("error"))


@query
def json_gate(spark, d):
    return views.model_output(spark, d).select("doc_id", strict_json("raw_output").isNotNull().alias("json_valid"))


@query
def schema_gate(spark, d):
    return check_answers(views.model_output(spark, d)).select(
        "doc_id", "json_valid", "valid", F.array_join("errors", ", ").alias("errors")
    )


@query
def typed_invoice(spark, d):
    return check_answers(views.model_output(spark, d)).select("doc_id", record_json("record").alias("invoice_json"))


def _calls(spark, d, models=("large", "small")) -> DataFrame:
    """Model answers as finished calls: usage is counted in characters of text and answer."""
    priced = F.when(F.col("model") == "large", PRICED_AS["large"]).otherwise(PRICED_AS["small"])
    return views.model_output(spark, d, models).withColumns(
        {
            "job_id": F.concat_ws("-", "model", "doc_id"),
            "model_used": priced,
            "model_error": answer_error("raw_output"),
            "fallback_used": F.col("model") == "small",
            "latency_seconds": F.lit(LATENCY),
            "input_tokens": F.char_length("raw_text").cast("bigint"),
            "output_tokens": F.char_length("raw_output").cast("bigint"),
        }
    )


@query
def outcomes_query(spark, d):
    return outcomes(add_cost(check_answers(_calls(spark, d))))



@query
def cost_estimate(spark, d):
    documents = views.documents(spark, d).withColumns(
        {
            "model_used": F.get(F.array(*[F.lit(m) for m in views.MODELS]), (F.col("doc_id") % 3).cast("int")),
            "input_tokens": word_count("raw_text").cast("bigint"),
            "output_tokens": F.char_length("raw_text").cast("bigint"),
        }
    )
    return add_cost(documents).select("doc_id", "model_used", "input_tokens", "output_tokens", "estimated_cost_usd")


@query
def canonical_json_query(spark, d):
    once = canonical_json("raw_output")
    answers = views.model_output(spark, d).select("doc_id", "raw_output", once.alias("text"))
    parsed = strict_json("text").isNotNull()
    return answers.select(
        "doc_id",
        parsed.alias("parsed"),
        (canonical_json("text") == F.col("text")).alias("stable"),
        F.when(~parsed, F.col("text")).alias("kept_text"),
        F.try_variant_get(strict_json("text"), "$.invoice_number", "string").alias("invoice_number"),
    )



@query
def baseline_table_query(spark, d):
    return baseline_table(outcomes(add_cost(check_answers(_calls(spark, d, ("large",))))))



# --- request log ---------------------------------------------------------------------
@query
def stats_global(spark, d):
    return requestlog.stats(views.request_log(spark, d))


@query
def recent_topk(spark, d):
    return requestlog.recent(views.request_log(spark, d)).withColumn("created_at", _day("created_at"))


@query
def stats_by_model(spark, d):
    return requestlog.stats_by_model(views.request_log(spark, d))


@query
def latency_trend(spark, d):
    return requestlog.latency_trend(views.request_log(spark, d))


@query
def recent_report(spark, d):
    return requestlog.recent_report(views.request_log(spark, d))


@query
def item_table(spark, d):
    return requestlog.item_table(views.invoices(spark, d), ["doc_id"]).withColumn(
        "item_pos", F.col("item_pos").cast("bigint")
    )


# --- labelled-dataset building -------------------------------------------------------
@query
def generate_invoices(spark, d):
    # Eight bytes a row: a file of one row group would otherwise be one task of many draws.
    ids = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).repartition("doc_id")
    return dataset.generate_invoices(ids).select("doc_id", _label_json().alias("label"))


@query
def invoice_totals(spark, d):
    sums = views.invoice_sums(spark, d)
    rate = F.get(F.array(*[F.lit(r) for r in fv.TAX_RATES]), (F.col("doc_id") % 5).cast("int")).cast("decimal(5,4)")
    rated = sums.withColumns({"tax_rate": rate, "omit_tax": (F.col("doc_id") % 10).isin(1, 4, 7)})
    return dataset.add_totals(rated).select("doc_id", "n_items", "subtotal", "tax", "total")


@query
def assemble_invoices(spark, d):
    return views.invoices(spark, d).select("doc_id", F.to_json("invoice.line_items", {"ignoreNullFields": "false"}).alias("items"))


@query
def omit_fields(spark, d):
    return views.invoice_headers(spark, d).select(
        "doc_id", "invoice_number", F.col("invoice_date").cast("string").alias("invoice_date"),
        "subtotal", "tax_amount", "total_amount",
    )


@query
def render_text(spark, d):
    return views.pairs(spark, d).select("doc_id", "raw_text")


def _recovered(spark, d, models=("large",)) -> DataFrame:
    """Checked answers with what the round trip compares."""
    return check_answers(views.model_output(spark, d, models)).select(
        "doc_id", "model", "raw_text", "raw_output", "valid",
        F.col("record.total_amount.text").alias("found_total"),
        F.col("record.vendor_name").alias("found_vendor"),
        F.col("invoice.total_amount").alias("target_total"),
        F.col("invoice.vendor_name").alias("target_vendor"),
    )


def _passed() -> Column:
    return dataset.roundtrip_ok("valid", "found_total", "found_vendor", "target_total", "target_vendor")


@query
def roundtrip_filter(spark, d):
    return _recovered(spark, d).where(_passed()).select("doc_id", "target_total", "found_total")


@query
def dedup_texts(spark, d):
    documents = views.documents(spark, d)
    toxic = views.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    history = documents.join(toxic, "doc_id", "left_semi")
    kept = dataset.drop_duplicates(documents, "raw_text", "doc_id", history)
    return kept.select("doc_id", F.md5("raw_text").alias("text_md5"))


@query
def hash_split(spark, d):
    bucket = sha256_mod_10000("raw_text")
    return views.documents(spark, d).select(
        "doc_id", bucket.alias("bucket"), dataset.is_test_row("raw_text").alias("is_test")
    )


@query
def build_counters(spark, d):
    # Two answers per document are two attempts at the same text.
    attempts = _recovered(spark, d, ("large", "small")).select(
        "raw_text", _passed().alias("passed"), is_blank("raw_output").alias("failed")
    )
    return dataset.build_counters(attempts, "raw_text", F.col("failed"), F.col("passed"))


@query
def build_counters_history(spark, d):
    """The same against a history that holds the texts of every tenth document."""
    attempts = _recovered(spark, d, ("large", "small")).select(
        "raw_text", _passed().alias("passed"), is_blank("raw_output").alias("failed")
    )
    history = views.pairs(spark, d).where("doc_id % 10 = 0").select("raw_text")
    return dataset.build_counters(attempts, "raw_text", F.col("failed"), F.col("passed"), dataset.text_digests(history, "raw_text"))


@query
def build_dataset(spark, d):
    """Two runs of the dataset job: statuses of each, with hits in the history, and the rows of the splits."""
    path = fresh_path(spark, "dataset")
    answers = check_answers(views.model_output(spark, d, ("large", "small"))).select(
        (F.col("doc_id") * 2 + (F.col("model") == "small").cast("int")).alias("attempt_id"), "doc_id", "model", "raw_text", "raw_output", "invoice", "valid",
        F.col("record.total_amount.text").alias("found_total"), F.col("record.vendor_name").alias("found_vendor"),
        F.col("invoice.total_amount").alias("target_total"), F.col("invoice.vendor_name").alias("target_vendor"),
    )
    first = answers.where("model = 'large' AND doc_id % 2 = 0")
    parts = [(run, build.build(rows, path, is_blank("raw_output"), _passed())) for run, rows in enumerate([first, answers])]
    counts = [rows.select(F.lit(run).alias("run"), "status", "n") for run, rows in parts]
    splits = [rows.select(F.lit(1).alias("run"), F.lit(name).alias("status")).groupBy("run", "status").agg(F.count(F.lit(1)).alias("n"))
              for name, rows in (("train", jsonl.read_train(spark, f"{path}/train")), ("test", jsonl.read_pairs(spark, f"{path}/test")))]
    return counts[0].unionByName(counts[1]).unionByName(splits[0]).unionByName(splits[1])


# --- dataset profile -----------------------------------------------------------------
@query
def vendor_profile(spark, d):
    return profile.vendor_profile(views.invoice_headers(spark, d), vendor="vendor_name").select(
        "vendor_name", "n", "total_rows", "distinct_vendors"
    )


@query
def currency_share(spark, d):
    return profile.currency_share(views.invoice_headers(spark, d), currency="currency")


@query
def item_count_stats(spark, d):
    return profile.item_count_stats(views.invoice_headers(spark, d), n_items="n_items")


@query
def omission_rates(spark, d):
    return profile.omission_rates(views.invoice_headers(spark, d), prefix="")


@query
def text_length_stats(spark, d):
    return profile.text_length_stats(views.pairs(spark, d))


@query
def missing_descriptions(spark, d):
    return profile.missing_descriptions(views.noisy_pairs(spark, d))


@query
def missing_totals(spark, d):
    return profile.missing_totals(views.noisy_pairs(spark, d))


@query
def duplicate_count(spark, d):
    return profile.duplicate_count(views.documents(spark, d))


@query
def flagged_items(spark, d):
    return profile.flagged_items(views.noisy_pairs(spark, d), DOC).select(
        "doc_id", F.col("item_pos").cast("bigint").alias("item_pos"), "description", "total", "raw_text"
    )


# --- evaluation ----------------------------------------------------------------------
def evaluated(spark, d, models=("large", "small")) -> DataFrame:
    """Model answers through both gates, as (truth, prediction) label structs."""
    checked = check_answers(views.model_output(spark, d, models))
    return checked.select(
        *BY_MODEL, "dataset", "raw_text", "raw_output", "json_valid", "invoice", record_label("record").alias("prediction")
    )


@query
def normalise_fields(spark, d):
    return evaluated(spark, d, ("large",)).where("prediction IS NOT NULL").select(
        "doc_id",
        norm_text("prediction.vendor_name").alias("vendor_name"),
        norm_number("prediction.total_amount").cast("decimal(18,2)").alias("total_amount"),
        norm_number(F.concat(F.lit("$"), F.format_number(F.col("prediction.total_amount").cast("decimal(18,2)"), 2)))
        .cast("decimal(18,2)").alias("from_display"),
    )


@query
def field_accuracy(spark, d):
    return evaluate.field_accuracy(evaluated(spark, d), ["model"])


@query
def per_field_accuracy(spark, d):
    return evaluate.per_field_accuracy(evaluated(spark, d), ["model"])


@query
def valid_rate(spark, d):
    return evaluate.valid_rate(evaluated(spark, d), ["model", "dataset"])


@query
def item_prf(spark, d):
    return evaluate.item_prf(evaluated(spark, d), ["model", "dataset"], BY_MODEL).select(
        "model", "dataset", "label_items", "predicted_items", "matched", "item_recall", "item_precision", "item_f1"
    )


@query
def complete_item(spark, d):
    return evaluate.item_prf(evaluated(spark, d), ["model"], BY_MODEL).select(
        "model", "label_items", "complete", "complete_item"
    )


@query
def missing_extra_items(spark, d):
    return evaluate.missing_extra_items(evaluated(spark, d), BY_MODEL)


@query
def error_taxonomy(spark, d):
    keys = BY_MODEL
    labels = views.table(spark, d, "labels").where("quality = 0").select(
        F.explode(F.array(*[F.lit(m) for m in views.ANSWERING])).alias("model"),
        "doc_id",
        F.lit("annotation").alias("level"), F.lit("ANNOTATION_AMBIGUITY").alias("code"),
    )
    return evaluate.error_taxonomy(evaluate.example_errors(evaluated(spark, d), keys, labels), ["model"])


@query
def hallucination_flags(spark, d):
    return evaluate.with_flags(evaluated(spark, d)).select(
        "model", "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("hallucinated", "hallucinated_amounts")], "truncated"
    )


@query
def evidence_spans(spark, d):
    """Dates, amounts, quantities and codes that every document states, and whether their places hold them."""
    texts = views.pairs(spark, d).select("doc_id", "raw_text")
    # Unpacked from a list so that a text is read once, not once more for the filter.
    read = texts.withColumn("_read", F.struct(evidence.places().alias("places")))
    found = read.select("doc_id", "raw_text", F.inline(F.array("_read"))).where(F.size("places") > 0)

    def count(kind: str) -> Column:
        return F.size(F.filter("places", lambda p: p["kind"] == kind)).cast("bigint")

    there = F.forall("places", lambda p: F.substring("raw_text", p["start"].cast("int") + 1, (p["stop"] - p["start"]).cast("int")) == p["text"])
    return found.select(
        "doc_id", count("date").alias("dates"), count("amount").alias("amounts"), count("quantity").alias("quantities"), count("code").alias("codes"), there.alias("aligned")
    )


@query
def results_table(spark, d):
    return evaluate.results_table(evaluated(spark, d), BY_MODEL)


@query
def model_delta(spark, d):
    return evaluate.model_delta(evaluate.results_table(evaluated(spark, d), BY_MODEL), "small", "large")


@query
def sample_check(spark, d):
    return evaluate.document_checks(evaluated(spark, d, ("large",)), BY_MODEL).select(
        "doc_id", F.col("fields_right").cast("bigint").alias("fields_right"),
        "label_items", "predicted_items", "complete", "passed",
    )


@query
def run_artifacts(spark, d):
    path = fresh_path(spark, "runs")
    run = {"run_id": "run-1", "model_version": "1", "prompt_version": "1", "dataset_version": "1", "config": "temperature=0"}
    evaluate.write_run(evaluated(spark, d), BY_MODEL, path, run)
    metrics = spark.read.parquet(f"{path}/metrics")
    examples = spark.read.parquet(f"{path}/examples").groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(F.col("prediction_norm").isNotNull()).alias("normalised")
    )
    return metrics.join(examples, ["model", "dataset"]).select(
        "run_id", "prompt_version", "config", "model", "dataset", "metric", "value", "examples", "normalised"
    )


# --- training rows -------------------------------------------------------------------
def _training_rows(spark, d) -> DataFrame:
    completion = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat_ws(" ", "lang", "source"))
    return views.table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), completion.alias("completion"))


@query
def pack_training_rows(spark, d):
    packed = training.pack_training_rows(_training_rows(spark, d))
    kept = F.filter("labels", lambda x: x != fv.MASKED_LABEL)
    return packed.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("length"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("real_tokens"),
        F.size(kept).cast("bigint").alias("label_tokens"),
        (F.size("labels") == F.size("attention_mask")).alias("aligned"),
    )


@query
def pack_subword_rows(spark, d):
    """Training rows of real tokens: the labels spell the start of the completion, masks cover prompt and padding."""
    rows = _training_rows(spark, d).repartition("doc_id")
    packed = training.pack_training_rows(rows, subwords.subword_tokens(TOKENIZER_FILE))
    labels = F.filter("labels", lambda x: x != fv.MASKED_LABEL)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    spelled = packed.select("*", labels.alias("_labels"), real.alias("_real")).withColumn("_text", subwords.subword_text(TOKENIZER_FILE)(F.col("_labels")))
    # A cut through a character leaves a replacement mark at the end.
    start = F.rtrim("_text", F.lit("\ufffd"))
    whole = F.size("_labels") < fv.MAX_LENGTH
    return spelled.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("length"),
        (F.when(whole, F.col("_text") == F.col("completion")).otherwise(F.startswith("completion", start))).alias("spells_completion"),
        (F.slice("input_ids", F.col("_real") - F.size("_labels") + 1, F.size("_labels")) == F.col("_labels")).alias("labels_are_inputs"),
        (F.size(F.filter("labels", lambda x: x == fv.MASKED_LABEL)) == F.lit(fv.MAX_LENGTH) - F.size("_labels")).alias("rest_is_masked"),
    )


@query
def train_valid_split(spark, d):
    return training.train_valid_split(views.documents(spark, d), "doc_id").select("doc_id", "split")


# --- streams -------------------------------------------------------------------------
def _table_stream(spark, d, name: str) -> DataFrame:
    schema = views.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query
def stream_extract(spark, d):
    inbox, log = fresh_path(spark, "inbox"), fresh_path(spark, "log")
    submitted = views.pairs(spark, d).select(F.col("doc_id").cast("string").alias("job_id"), "raw_text")
    with cleaned(spark):
        submitted.write.parquet(inbox)
    arriving = spark.readStream.schema(submitted.schema).option("maxFilesPerTrigger", 4).parquet(inbox)
    models = [_reader("primary", [0, 1, 2]), _reader("fallback", [0, 1, 2, 3])]
    stream.stream_extract(arriving, models, log, fresh_path(spark, "state"))
    return stream.read_batches(spark, log).select(
        "job_id", "success", "model_name", "error", F.get_json_object("invoice_json", "$.total_amount").alias("total_amount")
    )


@query
def stream_idempotent(spark, d):
    log = fresh_path(spark, "log")
    events = _table_stream(spark, d, "events")
    # The same files under a new checkpoint arrive as a retry of every job.
    for _ in range(2):
        stream.stream_records(views.request_log_from(events), log, fresh_path(spark, "state"))
    return stream.read_batches(spark, log).select("job_id", "model_name", "success", "estimated_cost_usd")


@query
def stream_stats(spark, d):
    path = fresh_path(spark, "stats")
    stream.stream_stats(views.request_log_from(_table_stream(spark, d, "events")), path, fresh_path(spark, "state"))
    return stream.read_stats(spark, path)
