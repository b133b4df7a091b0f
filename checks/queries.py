"""One query per operator, each over whole given tables."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from filewright import constants as C
from filewright import profile, sinks
from filewright.config import RetentionPolicy, Taxonomy, drift
from filewright.functions import paths, replies as R, text as T, tokens, wire
from filewright.functions.verdicts import accept, is_confident, verdict
from filewright.operators import placement, policy, reconcile, routing, rules
from filewright.plans import jobs, pipeline
from filewright.session import cut_lineage, shared_path
from filewright.sources import files, inventory, previews
from filewright.streaming import KeyedTable, classify_stream, latest, progress_stream, reconcile_stream, start, worker_stats_stream, write_once

TAXONOMY = Taxonomy()
POLICY = RetentionPolicy.default()
CHARS = TAXONOMY.max_chars
PLAN = ["seq", "path", "category", "confidence", "method", "reason"]


def _plan(spark: SparkSession, d: str) -> DataFrame:
    files = X.files(spark, d).select("seq", "path", "size_bytes")
    return pipeline.classify(files, TAXONOMY, pipeline.RULES_ONLY).select(*PLAN)


# ----------------------------------------------------------------- inventory


def inventory_filtered(spark, d):
    return inventory.candidates(X.listing(spark, d), "/corpus", TAXONOMY.names).select("path", "size_bytes")


def inventory_top_level(spark, d):
    return inventory.candidates(X.listing(spark, d), "/corpus", TAXONOMY.names, recursive=False).select("path", "size_bytes")


def path_parts(spark, d):
    f = X.files(spark, d).select("seq", "path").withColumn("name", paths.basename(F.col("path")))
    stem, suffix = paths.stem_and_suffix(F.col("name"))
    root, ext = paths.root_and_extension(F.col("name"))
    rel = paths.relative(F.col("path"), "/corpus")
    return f.select(
        "seq", "name", paths.extension(F.col("name")).alias("ext"), root.alias("root"), ext.alias("root_ext"),
        stem.alias("stem"), suffix.alias("suffix"), paths.head(rel).alias("head"),
        paths.dirname(F.col("path")).alias("folder"))


def _on_disk(spark, d) -> tuple[DataFrame, str]:
    """Documents written as files of a shared folder: some hidden, some with an underscore first, some in folders. And the folder."""
    docs, folder = X.load(spark, d, "documents"), shared_path(spark)
    name = X.fill(X.pick(["doc_{id}.txt", ".x_{id}", "_x_{id}.md", "sub/doc_{id}.txt", "sub/.deep/_{id}.log", "_sub/{id}.txt"], F.col("doc_id")), F.col("doc_id"))
    files.write_texts(docs.select(name.alias("name"), "text"), folder).write.format("noop").mode("overwrite").save()
    return docs, folder


def _below(folder: str) -> Column:
    return F.regexp_replace("path", rf"^.*/{folder.rsplit('/', 1)[1]}/", "")


def inventory_on_disk(spark, d):
    """A folder listed from disk."""
    _, folder = _on_disk(spark, d)
    return files.list_files(spark, folder, recursive=True).select(_below(folder).alias("name"), "size_bytes")


def text_on_disk(spark, d):
    """The first characters of files on disk, as far as a snippet needs them."""
    _, folder = _on_disk(spark, d)
    return files.read_text(spark, folder, recursive=True, chars=2 * CHARS).select(_below(folder).alias("name"), "text")


# ------------------------------------------------------------------ rules


def tokenize_names(spark, d):
    f = rules.with_names(X.files(spark, d).select("seq", "path"))
    return f.select("seq", "flat", F.size(tokens.tokens(F.col("flat"))).alias("n_tokens"))


def tokenize_parts(spark, d):
    p = X.load(spark, d, "part")
    return p.select("p_partkey", tokens.flat_name(F.concat("p_name", F.lit("_"), "p_type")).alias("flat"))


def hc_match(spark, d):
    f = rules.with_markers(rules.with_names(X.files(spark, d).select("seq", "path")), TAXONOMY)
    return f.where("marker is not null").select("seq", "marker.*")


def keyword_match(spark, d):
    f = rules.with_keyword(rules.with_names(X.files(spark, d).select("seq", "path")), TAXONOMY)
    return f.where("keyword is not null").select("seq", "keyword.*")


def junk_and_archives(spark, d):
    f = rules.with_names(X.files(spark, d).select("seq", "path"))
    f = f.withColumns({"junk": rules.junk(TAXONOMY), "archive": rules.archive(TAXONOMY)})
    return f.select(
        "seq", F.col("junk.category").alias("junk"), F.col("archive.category").alias("archive"),
        F.col("archive.reason").alias("archive_reason"))


def rules_plan(spark, d):
    return _plan(spark, d)


def category_counts(spark, d):
    return pipeline.category_counts(_plan(spark, d))


def confident_files(spark, d):
    return _plan(spark, d).where(is_confident(F.col("category"), F.col("confidence"))).select("seq", "category")


# ------------------------------------------------------------------- text


def text_snippet(spark, d):
    docs = X.load(spark, d, "documents")
    return docs.select("doc_id", T.strip(F.substring("text", 1, CHARS)).alias("snippet"))


def snippet_redacted(spark, d):
    return X.secrets(spark, d).select("doc_id", T.snippet(F.col("text"), 1500).alias("snippet"))


def redact_text(spark, d):
    return X.secrets(spark, d).select("doc_id", T.redact(F.col("text")).alias("redacted"))


def redact_specific_first(spark, d):
    return X.secrets(spark, d).select("doc_id", T.redact(F.col("text"), "specific_first").alias("redacted"))


def redaction_counts(spark, d):
    counted = X.secrets(spark, d).select("doc_id", T.redaction_counts(F.col("text")).alias("c"))
    return counted.select("doc_id", "c.*")


def snippet_dispatch(spark, d):
    f = rules.with_names(X.files(spark, d).select("seq", "path", "text"))
    return previews.with_snippet(f, CHARS).select("seq", "ext", "snippet")


def html_snippet(spark, d):
    f = rules.with_names(X.html_files(spark, d))
    return previews.with_snippet(f, CHARS, csv_files=False).select("seq", "snippet")


def page_snippet(spark, d):
    c = X.load(spark, d, "conversations")
    pages = previews.page_text(c, "conv_id", "turn", "text", max_chars=CHARS)
    return pages.select("conv_id", "text", T.snippet(F.col("text"), CHARS).alias("snippet"))


def paragraph_snippet(spark, d):
    # Every fourth paragraph is blank.
    c = X.load(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 1, " \n").otherwise(F.col("text")))
    found = previews.paragraph_text(c, "conv_id", "turn", "text", max_chars=CHARS)
    return found.select("conv_id", "text", T.snippet(F.col("text"), CHARS).alias("snippet"))


def table_preview(spark, d):
    out = None
    for table, key in (("orders", "o_orderkey"), ("nation", "n_nationkey"), ("part", "p_partkey")):
        df = previews.table_preview(X.load(spark, d, table), [key]).withColumn("table_name", F.lit(table))
        out = df if out is None else out.unionByName(df)
    return out


def csv_preview(spark, d):
    # A part's row is short, its preview is not: one small file is dealt to all cores before the work.
    spread = X.csv_files(spark, d).repartition(spark.sparkContext.defaultParallelism * 3)
    return spread.select("seq", previews.csv_preview("text").alias("preview"))


# ---------------------------------------------------------------- routing


def _routed(spark, d):
    return routing.with_route(rules.with_names(X.files(spark, d).select("seq", "path", "size_bytes")))


def route_files(spark, d):
    f = rules.with_names(X.files(spark, d).select("seq", "path", "size_bytes"))
    with_images = routing.route_column(routing.default_routes(images=True))
    return routing.with_route(f).select("seq", "route", with_images.alias("route_with_images"))


def route_counts(spark, d):
    return routing.route_counts(_routed(spark, d))


def active_routes(spark, d):
    return _routed(spark, d).where(F.col("route") != C.ROUTE_NONE).select("route").distinct()


def capacity_plan(spark, d):
    return routing.worker_counts(route_counts(spark, d), routing.capacity_table(spark))


def walltime_estimate(spark, d):
    rates = spark.createDataFrame([(C.ROUTE_SMALL, 0.5), (C.ROUTE_LARGE, 0.125)], "route string, files_per_second double")
    return routing.wall_time(capacity_plan(spark, d), rates)


def model_for_route(spark, d):
    r = _routed(spark, d)
    bare = {"default_local_model": "base", "large_model": "big", "models": {C.ROUTE_SMALL: ""}}
    return r.select(
        "seq", routing.model_for_route(F.col("route"), TAXONOMY.settings).alias("model"),
        routing.model_for_route(F.col("route"), bare).alias("fallback"),
        routing.model_for_route(F.col("route"), bare, "mine").alias("forced"))


# ---------------------------------------------------------------- scoring


def parse_replies(spark, d):
    r = X.replies(spark, d).withColumn("v", R.parse_reply(F.col("reply"), TAXONOMY.names))
    return r.select("reply_seq", "v.*")


def accepted_replies(spark, d):
    # Through an array, so that no filter is pushed below the parser and repeats it.
    kept = accept(R.parse_reply(F.col("reply"), TAXONOMY.names), TAXONOMY.threshold)
    found = F.filter(F.array(kept), lambda v: v.isNotNull())
    return X.replies(spark, d).select("reply_seq", F.explode(found).alias("v")).select("reply_seq", "v.*")


def build_prompts(spark, d):
    f = rules.with_names(X.files(spark, d).select("seq", "path", "text"))
    f = previews.with_snippet(f, CHARS)
    prompt = R.build_prompt(
        F.col("name"), F.col("snippet"), TAXONOMY.names, "Pick one of {categories} for {filename}: {snippet}",
        redact_filename=True)
    return f.where(~T.is_blank(F.col("snippet"))).select("seq", prompt.alias("prompt"))


def model_stage_plan(spark, d):
    return pipeline.classify(X.files(spark, d), TAXONOMY, replies=X.replies(spark, d)).select(*PLAN)


def scored_plan(spark, d):
    """The model stage with a scorer that runs in Python workers."""
    return pipeline.classify(X.files(spark, d), TAXONOMY, scorer=sample_scorer(X.ANSWERS)).select(*PLAN)


def sample_scorer(answers: list[str], fails: int = 0):
    """Factory of a scorer that answers by the length of the text in the prompt, and fails where ``fails`` divides it."""
    def factory():
        import json

        def score(prompts: list[str], models: list[str]) -> list[str]:
            out = []
            for prompt in prompts:
                size = len(prompt.split("Start of its text: ", 1)[1].split("\n\nTrust clear markers", 1)[0])
                if fails and size % fails == 0:
                    raise ValueError("a prompt of this length cannot be scored")
                reply = {"category": answers[size % len(answers)], "confidence": size % 101, "reason": f"length {size}"}
                out.append(json.dumps(reply))
            return out

        return score

    return factory


def prefilter_plan(spark, d):
    f = _routed(spark, d).where(F.col("route") == C.ROUTE_NONE).select("seq", "path")
    return pipeline.prefilter(f, TAXONOMY).select(*PLAN)


def merged_plan(spark, d):
    return pipeline.routed(X.files(spark, d), TAXONOMY, replies=X.replies(spark, d)).select("route", *PLAN)


def prefilter_hits(spark, d):
    return pipeline.prefilter_hits(pipeline.routed(X.files(spark, d), TAXONOMY))


# -------------------------------------------------------------- reconcile


def job_verdicts(spark, d):
    return reconcile.job_verdicts(
        X.jobs(spark, d), X.results(spark, d), F.col("enqueued_at") + F.expr(f"INTERVAL {C.RUN_TIMEOUT_SECONDS} SECONDS"))


def job_verdicts_batch_deadline(spark, d):
    return reconcile.job_verdicts(X.jobs(spark, d), X.results(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"))


def stray_results(spark, d):
    return reconcile.stray_results(X.results(spark, d, gaps=False), X.jobs(spark, d)).select("job_id", "file_path", "result_seq")


def orchestration_stats(spark, d):
    v = job_verdicts(spark, d)
    total = reconcile.run_stats(v).withColumn("route", F.lit("all"))
    return reconcile.run_stats(v, by_route=True).unionByName(total)


def worker_stats(spark, d):
    return reconcile.worker_stats(X.results(spark, d, gaps=False)).withColumn("total_duration_ms", F.round("total_duration_ms", 2))


def route_backlog(spark, d):
    return reconcile.backlog(X.jobs(spark, d), X.results(spark, d))


def progress_running(spark, d):
    return reconcile.progress(X.results(spark, d, gaps=False)).select("result_seq", "route", "completed_on_route", "failed_on_route")


def progress_ticks(spark, d):
    return reconcile.progress_ticks(X.results(spark, d, gaps=False))


def job_json_roundtrip(spark, d):
    j = X.jobs(spark, d)
    encoded = j.select(wire.encode_job(j).alias("job"))
    part = lambda path, kind: F.try_variant_get("payload", path, kind)
    return wire.decode_jobs(encoded).select(
        "job_id", "file_path", "route", part("$.props", "string").alias("props"), part("$.n", "bigint").alias("n"),
        part("$.x", "double").alias("x"), part("$.o.k[1]", "bigint").alias("k1"), part("$.even", "boolean").alias("even"),
        F.schema_of_variant(part("$.o", "variant")).alias("o_schema"), F.is_variant_null(part("$.none", "variant")).alias("none_is_null"),
        "attempts", "max_attempts", F.unix_micros("enqueued_at").alias("enqueued_micros"))


def job_json_defaults(spark, d):
    e = X.load(spark, d, "events")
    text = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","file_path":"/f","route":"'), "event_type", F.lit('"}'))
    out = wire.decode_jobs(e.select(text.alias("job")), now=F.timestamp_seconds(F.lit(0)))
    return out.select(
        "job_id", "file_path", "route", F.size(F.try_variant_get("payload", "$", "map<string,string>")).alias("payload_size"), "attempts", "max_attempts",
        F.unix_micros("enqueued_at").alias("enqueued_micros"))


def result_json_roundtrip(spark, d):
    r = X.results(spark, d, gaps=False)
    encoded = r.select(wire.encode_result(r).alias("result"), "done_at")
    out = wire.decode_results(encoded, done_at=F.col("done_at"))
    return out.select(
        "job_id", "file_path", "route", "worker_id", "duration_ms", F.col("classification.category").alias("category"),
        F.coalesce("classification.confidence", F.lit(-1)).alias("confidence"), "error",
        reconcile.is_ok(F.col("error"), F.col("classification")).alias("ok"))


def make_jobs(spark, d):
    j = reconcile.make_jobs(_routed(spark, d), "run-1", "2024-01-01 00:00:00")
    return j.select("job_id", "file_path", "route", "attempts", "max_attempts")


def elapsed_times(spark, d):
    """Times of a result: epoch, ISO text and time since its job was queued."""
    r = X.results(spark, d, gaps=False).select("job_id", "result_seq", "done_at").join(
        X.jobs(spark, d).select("job_id", "enqueued_at"), "job_id")
    return r.select(
        "result_seq", wire.iso(F.col("done_at")).alias("done_iso"),
        F.round(wire.epoch_seconds(F.col("done_at")), 3).alias("done_epoch"),
        wire.elapsed_ms(F.col("enqueued_at"), F.col("done_at")).alias("waited_ms"))


# ---------------------------------------------------- policy and placement


def disposition_partition(spark, d):
    return policy.with_disposition(_plan(spark, d), POLICY).select(
        "seq", "path", "category", "disposition", "never_export", "exportable")


def disposition_counts(spark, d):
    return policy.disposition_counts(_plan(spark, d), POLICY)


def _existing(spark, d):
    """Files already in the bundle: copies of names of the plan, some numbered."""
    p = _plan(spark, d).where("seq % 7 = 0").select("category", paths.basename(F.col("path")).alias("name"), "seq")
    root, ext = paths.root_and_extension(F.col("name"))
    numbered = F.concat(root, F.lit("_"), (F.col("seq") % 5 + 1).cast("string"), ext)
    return p.select(F.explode(F.array(
        F.concat_ws("/", F.lit("/bundle"), "category", "name"),
        F.concat_ws("/", F.lit("/bundle"), F.col("category"), numbered))).alias("path"))


def export_plan(spark, d):
    existing = placement.existing_names(_existing(spark, d), "/bundle")
    return placement.export_plan(_plan(spark, d), POLICY, "/bundle", existing).select("seq", "path", "category", "dest", "status")


def export_barred(spark, d):
    """A policy that keeps secrets by mistake still exports none of them."""
    kept = {**profile.DISPOSITIONS, "keep": [*profile.DISPOSITIONS["keep"], "Credentials_Secrets"], "review": [C.UNKNOWN]}
    wrong = RetentionPolicy.of(kept, profile.NEVER_EXPORT)
    out = placement.export_plan(_plan(spark, d), wrong, "/bundle")
    return out.groupBy("status", "category").agg(F.count("*").alias("files"), F.count("dest").alias("placed"))


def manifest(spark, d):
    return policy.manifest(_plan(spark, d), POLICY, applied=True)


def review_list(spark, d):
    return policy.review_list(_plan(spark, d), POLICY)


def policy_drift(spark, d):
    return drift(_plan(spark, d), POLICY.table(spark))


def move_plan(spark, d):
    return placement.move_plan(_plan(spark, d), "/sorted").select("seq", "path", "category", "dest")


def move_log(spark, d):
    """The moves of two runs, appended to a log one after the other and read back."""
    moves, folder = cut_lineage(move_plan(spark, d)), shared_path(spark)
    for run, part in (("even", "seq % 2 = 0"), ("odd", "seq % 2 <> 0"), ("none", "seq < 0")):
        sinks.append_move_log(placement.move_log(moves.where(part), run, "2024-01-01 00:00:00"), folder)
    return sinks.read_move_log(spark, folder).select("run_id", "seq", "original", "new", "category")


def _undo_input(spark, d):
    moves = cut_lineage(move_plan(spark, d))
    log = placement.move_log(moves, "run-1", "2024-01-01 00:00:00")
    # Four moved files in five are still there; some places were taken again.
    present = moves.where("seq % 5 <> 0").select(F.col("dest").alias("path"))
    back = moves.where("seq % 3 = 0").select("path")
    name, ext = paths.root_and_extension(F.col("path"))
    numbered = moves.where("seq % 4 = 0").select(F.concat(name, F.lit("_restored_1"), ext).alias("path"))
    return log, present.unionByName(back).unionByName(numbered)


def undo_plan(spark, d):
    log, listing = _undo_input(spark, d)
    return placement.undo_plan(log, listing).select("seq", "original", "new", "restored_to", "status")


def export_bundle(spark, d):
    """Files exported with their contents, read back."""
    bundle, folder = export_plan(spark, d), shared_path(spark)
    sinks.write_bundle(bundle, X.files(spark, d).select("seq", "text"), folder, "seq")
    return sinks.read_bundle(spark, folder).select("seq", "path", "category", "dest", F.sha2("text", 256).alias("text_sha256"))


def undo_twice(spark, d):
    """A log of two runs taken back, and taken back again: the first undo has closed it."""
    log, listing = _undo_input(spark, d)
    folder = shared_path(spark)
    for part in ("seq % 2 = 0", "seq % 2 <> 0"):
        sinks.append_move_log(log.where(part), folder)
    counts = [placement.undo_counts(jobs.undo(spark, folder, listing, apply=True, at="2024-01-02 00:00:00")).withColumn("round", F.lit(i)) for i in (1, 2)]
    return counts[0].unionByName(counts[1])


def undo_counts(spark, d):
    log, listing = _undo_input(spark, d)
    return placement.undo_counts(placement.undo_plan(log, listing))


# ------------------------------------------------------- reports and hooks


def taxonomy_report(spark, d):
    """The taxonomy as a file has it, read back, with the files that each category got."""
    plan = pipeline.category_counts(_plan(spark, d))
    return _loaded_taxonomy().report(spark).join(plan, "category", "left").select(
        "cat_idx", "category", "extensions", "keywords", F.coalesce("files", F.lit(0)).alias("files"))


def _loaded_taxonomy() -> Taxonomy:
    with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as file:
        json.dump({"categories": profile.CATEGORIES, "settings": profile.SETTINGS}, file)
        file.flush()
        return Taxonomy.load(file.name)


def policy_report(spark, d):
    """The policy as a file has it, read back: categories of each disposition, and how many files they hold."""
    with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as file:
        json.dump({"dispositions": profile.DISPOSITIONS, "never_export": sorted(profile.NEVER_EXPORT)}, file)
        file.flush()
        loaded = RetentionPolicy.load(file.name)
    held = policy.disposition_counts(_plan(spark, d), loaded).groupBy("disposition").agg(F.sum("files").alias("files"))
    return loaded.report(spark).join(held, "disposition", "left").select(
        "disposition", F.array_join("categories", ",").alias("categories"), F.array_join("barred", ",").alias("barred"), F.coalesce("files", F.lit(0)).alias("files"))


def route_catalogue(spark, d):
    """Routes in the order in which they are tried, their notes, and the files on each."""
    held = routing.route_counts(_routed(spark, d))
    return routing.describe(spark).join(held, "route", "left").select("position", "route", "note", F.coalesce("files", F.lit(0)).alias("files"))


def failing_scorer_plan(spark, d):
    """A scorer that fails on some prompts: those rows go on to the rules, the others keep the model's answer."""
    return pipeline.classify(X.files(spark, d), TAXONOMY, scorer=sample_scorer(X.ANSWERS, fails=5)).select(*PLAN)


def own_stage_plan(spark, d):
    """A stage of one's own before the rules."""
    def small(df: DataFrame, taxonomy: Taxonomy):
        return df, F.when(F.col("size_bytes") < 20_000, verdict("Customer_Data", 70, "size", F.concat(F.lit("only "), F.col("size_bytes").cast("string"))))

    return pipeline.classify(X.files(spark, d).select("seq", "path", "size_bytes"), TAXONOMY, [small, pipeline.RULES]).select(*PLAN)


def observed_batches(spark, d):
    """What an observer of a stream's batches saw: rows and failures in all, whatever the batches."""
    results, seen = X.results(spark, d, gaps=False), []

    def watch(batch: DataFrame, batch_id: int) -> None:
        seen.append(batch.groupBy("route").agg(F.count("*").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors")).collect())

    start(_in_batches(results), write_once(shared_path(spark), watch), shared_path(spark)).awaitTermination()
    rows = [(r.route, r.rows, r.errors) for batch in seen for r in batch]
    return spark.createDataFrame(rows, "route string, rows long, errors long").groupBy("route").agg(
        F.sum("rows").alias("rows"), F.sum("errors").alias("errors"))


def sized_batches(spark, d):
    """How many batches of at most a thousand jobs each route takes: at least one, at most forty."""
    return X.jobs(spark, d).groupBy("route").agg(F.count("*").alias("jobs")).select(
        "route", "jobs", F.least(F.lit(40), F.greatest(F.lit(1), F.ceil(F.col("jobs") / 1000))).cast("bigint").alias("batches"))


# ---------------------------------------------------------------- streams


def _run(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Everything a stream reports for the input that is there now; with ``keys``, the last state of each."""
    spark = stream.sparkSession
    out = shared_path(spark)
    start(stream, write_once(out), shared_path(spark), "update" if keys else "append").awaitTermination()
    written = spark.read.parquet(out).select(*stream.columns, "batch_id")
    return latest(written, keys) if keys else written.drop("batch_id")


def _in_batches(df: DataFrame, batches: int = 3) -> DataFrame:
    """A stream over ``df`` as batches of one file that arrive one after the other."""
    path = shared_path(df.sparkSession)
    df.repartition(batches).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _in_time(df: DataFrame, time: str, ends: list, files: int = 4, clock: DataFrame | None = None) -> DataFrame:
    """A stream over ``df`` as batches of ``files`` files in order of ``time``, cut at ``ends``. The row ``clock`` comes after them."""
    path = shared_path(df.sparkSession)
    for start_at, end_at in zip([None, *ends], [*ends, None]):
        part = df if start_at is None else df.where(F.col(time) >= F.lit(start_at))
        part = part if end_at is None else part.where(F.col(time) < F.lit(end_at))
        part.repartition(files).write.mode("append").parquet(path)
    if clock is not None:
        clock.select(*[(F.col(f.name) if f.name in clock.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _quarters(df: DataFrame, time: str) -> list:
    """Times that cut ``df`` into four spans of equal length."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    return [] if low is None else [low + (high - low) * i / 4 for i in (1, 2, 3)]


def stream_classify(spark, d):
    files = X.files(spark, d, X.load_stream).select("seq", "path", "size_bytes")
    return _run(classify_stream(files, TAXONOMY, pipeline.RULES_ONLY).select(*PLAN))


def stream_progress(spark, d):
    results = X.results(spark, d, gaps=False)
    ticks = progress_stream(_in_time(results, "done_at", _quarters(results, "done_at")), late="5 minutes")
    return _run(ticks, ["route", "tick_end"]).select("route", "tick_end", "completed", "failed")


def stream_worker_stats(spark, d):
    stats = worker_stats_stream(_in_batches(X.results(spark, d, gaps=False)))
    return _run(stats, ["worker_id"]).withColumn("total_duration_ms", F.round("total_duration_ms", 2))


def stream_reconcile(spark, d):
    """First results of jobs, and timeouts of those without: jobs and results arrive in order of time, in four batches, and are
    late after five minutes. A last pair, later than every deadline, moves the watermark past all of them; it stays open itself."""
    jobs, results = X.jobs(spark, d), X.results(spark, d)
    last = jobs.agg(F.max("enqueued_at") + F.make_interval(secs=F.lit(C.RUN_TIMEOUT_SECONDS))).unionAll(results.agg(F.max("done_at"))).toDF("at")
    at = (F.max("at") + F.expr("INTERVAL 6 MINUTES")).alias("at")
    clock = last.agg(at).where("at IS NOT NULL").select(F.lit("clock").alias("job_id"), F.col("at").alias("enqueued_at"), F.col("at").alias("done_at"))
    ends = _quarters(jobs, "enqueued_at")
    found = reconcile_stream(
        _in_time(jobs, "enqueued_at", ends, clock=clock), _in_time(results, "done_at", ends, clock=clock),
        C.RUN_TIMEOUT_SECONDS, "5 minutes", "5 minutes")
    return _run(found)


def keyed_sink(spark, d):
    """Counters per worker as a keyed table: three batches, of which the last is written again as after a failure, and the
    row of each worker as the last commit has it."""
    results = X.results(spark, d, gaps=False)
    stats = worker_stats_stream(_in_batches(results))
    table = KeyedTable(spark, shared_path(spark), ["worker_id"], 4)
    seen: list[tuple[DataFrame, int]] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = cut_lineage(batch)
        table.merge(kept, batch_id)
        seen.append((kept, batch_id))

    start(stats, write, shared_path(spark), "update").awaitTermination()
    table.merge(*seen[-1])
    return table.read().withColumn("total_duration_ms", F.round("total_duration_ms", 2))


QUERIES = {f.__name__: f for f in (
    inventory_filtered, inventory_top_level, path_parts, tokenize_names, tokenize_parts, hc_match, keyword_match,
    junk_and_archives, rules_plan, category_counts, confident_files, text_snippet, snippet_redacted, redact_text,
    redact_specific_first, redaction_counts, snippet_dispatch, html_snippet, page_snippet, paragraph_snippet,
    table_preview, csv_preview, route_files, route_counts, active_routes, capacity_plan, walltime_estimate,
    model_for_route, parse_replies, accepted_replies, build_prompts, model_stage_plan, scored_plan, prefilter_plan,
    merged_plan, prefilter_hits, job_verdicts, job_verdicts_batch_deadline, stray_results, orchestration_stats,
    worker_stats, route_backlog, progress_running, progress_ticks, job_json_roundtrip, job_json_defaults,
    result_json_roundtrip, make_jobs, elapsed_times, disposition_partition, disposition_counts, export_plan,
    export_barred, manifest, review_list, policy_drift, move_plan, move_log, undo_plan, undo_counts, export_bundle, undo_twice, inventory_on_disk, text_on_disk, stream_classify, stream_reconcile,
    stream_progress, stream_worker_stats, keyed_sink,
    taxonomy_report, policy_report, route_catalogue, failing_scorer_plan, own_stage_plan, observed_batches, sized_batches,
)}
