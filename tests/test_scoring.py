import json

import pytest
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.config import Taxonomy
from filewright.functions import replies as R
from filewright.functions.verdicts import verdict
from filewright.operators import routing
from filewright.plans import jobs, pipeline

TAXONOMY = Taxonomy()
ALLOWED = ["Letters", "Bills", "Maps", "Unknown_Unsorted"]


def parse(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i long, r string").orderBy("i")
    out = df.select(R.parse_reply(F.col("r"), ALLOWED).alias("v")).collect()
    return [None if r.v is None else (r.v.category, r.v.confidence, r.v.reason) for r in out]


NOTHING, NO_JSON, NO_OBJECT = ((C.UNKNOWN, 0, why) for why in (
    "Ollama returned an empty string", "AI returned invalid JSON", "AI returned non-object JSON"))


def test_replies(spark):
    good = ("Bills", 71, "an invoice")
    body = '{"reason": "an invoice", "confidence": 71, "category": "Bills"}'
    cases = {
        body: good, f"  {body}\n": good, f"```json\n{body}\n```": good, f"```{body}```": good,
        "": NOTHING, " \t\n": NOTHING, "```json\n```": NO_JSON, "Bills": NO_JSON, f"{body} and so on": NO_JSON, f"{body}{body}": NO_JSON, f"{body}}}": NO_JSON,
        f"{body},": NO_JSON, "{'category': 'Bills'}": NO_JSON, '["Bills", 71]': NO_OBJECT, "null": NO_OBJECT, "71": NO_OBJECT, '"Bills"': NO_OBJECT, "false": NO_OBJECT,
        "{}": (C.UNKNOWN, 0, "AI classification"), '{"category": "Bills"}': ("Bills", 0, "AI classification"),
        '{"category": "Toys", "confidence": 71}': (C.UNKNOWN, 0, "AI suggested unknown category 'Toys'"),
        '{"category": null, "confidence": 71}': (C.UNKNOWN, 0, "AI suggested unknown category 'None'"),
        '{"category": "Ann\'s"}': (C.UNKNOWN, 0, 'AI suggested unknown category "Ann\'s"'),
        '{"category": "Toys", "category": "Maps", "confidence": 4}': ("Maps", 4, "AI classification"),
        '{"category": "Maps", "reason": null}': ("Maps", 0, "None"), '{"category": "Maps", "reason": 7}': ("Maps", 0, "7"),
    }
    confidences = {
        "101": 100, "-3": 0, "70.9": 70, "-0.1": 0, "3e1": 30, '"64"': 64, '" +64 "': 64, '"6_4"': 64, '"64.0"': 0, '"most"': 0, '""': 0, "true": 1,
        "false": 0, "null": 0, "[64]": 0, '{"v": 64}': 0, "98765432109876543210": 100, "NaN": 0,
    }
    cases |= {f'{{"category": "Bills", "confidence": {given}, "reason": "an invoice"}}': ("Bills", want, "an invoice") for given, want in confidences.items()}
    assert dict(zip(cases, parse(spark, list(cases)))) == cases
    assert parse(spark, ['{"category": "Bills", "confidence": 1e999}']) == [None]


def test_prompt_contains_all_parts_and_no_slot_injection(spark):
    df = spark.createDataFrame([("{snippet}.pdf", "body {filename}")], "n string, s string")
    got = df.select(R.build_prompt(F.col("n"), F.col("s"), ALLOWED)).first()[0]
    assert "{snippet}.pdf" in got and "body {filename}" in got and all(c in got for c in ALLOWED)


def files(spark, names, text="some text"):
    return spark.createDataFrame([(i, f"/in/{n}", 10, text) for i, n in enumerate(names)],
                                 "seq long, path string, size_bytes long, text string")


def answering(category, confidence=95):
    reply = json.dumps({"category": category, "confidence": confidence, "reason": "model"})

    def factory():
        return lambda prompts, models: [reply] * len(prompts)

    return factory


def plan(spark, names, scorer, run=pipeline.classify, **options):
    df = run(files(spark, names, options.pop("text", "some text")), TAXONOMY, scorer=scorer, **options)
    return {r.path[4:]: r for r in df.collect()}


def test_stage_order_markers_model_rules(spark):
    got = plan(spark, ["xlq.csv", "lettersT4.pdf", "my resume 7.pdf", "viewer.dmg", "plain.pdf"], answering("Medical_Health"))
    assert (got["xlq.csv"].category, got["xlq.csv"].method) == ("AstroQuant_Sidereal", "Rules (HC)")
    assert got["lettersT4.pdf"].category == "Canadian_PR_Docs"
    assert (got["my resume 7.pdf"].category, got["my resume 7.pdf"].method) == ("Medical_Health", "Local AI")
    assert got["viewer.dmg"].category == "Archives_and_Apps"
    assert got["plain.pdf"].category == "Medical_Health"


def test_below_threshold_and_blank_text_fall_back_to_rules(spark):
    assert plan(spark, ["my resume 7.pdf"], answering("Medical_Health", 59))["my resume 7.pdf"].category == "Resumes_Career_Tech"
    assert plan(spark, ["my resume 7.pdf"], answering("Medical_Health", 60))["my resume 7.pdf"].category == "Medical_Health"
    assert plan(spark, ["my resume 7.pdf"], answering("Medical_Health"), text=" \n")["my resume 7.pdf"].category == "Resumes_Career_Tech"


def failing_on_b():
    def factory():
        def score(prompts, models):
            if any("b_Resume" in p for p in prompts):
                raise RuntimeError("bad prompt")
            return ['{"category":"Medical_Health","confidence":90}'] * len(prompts)

        return score

    return factory


def test_a_failing_row_skips_the_stage_for_that_row_only(spark):
    got = plan(spark, ["a_Resume.pdf", "b_Resume.pdf", "c_Resume.pdf"], failing_on_b())
    assert [got[n].category for n in sorted(got)] == ["Medical_Health", "Resumes_Career_Tech", "Medical_Health"]


def test_scorer_sees_only_rows_that_need_it(spark):
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def score(prompts, models):
            seen.add(len(prompts))
            return [""] * len(prompts)
        return score

    names = [f"lettersT4_{i}.pdf" for i in range(90)] + [f"plain_{i}.pdf" for i in range(10)]
    plan(spark, names, factory)
    assert seen.value == 10


def models_used():
    def factory():
        return lambda prompts, models: ['{"category":"Medical_Health","confidence":99,"reason":"%s"}' % m for m in models]

    return factory


def test_model_follows_the_route(spark):
    df = files(spark, ["a.pdf", "b.pdf"]).withColumn("size_bytes", F.when(F.col("seq") == 0, 10).otherwise(3 << 20).cast("bigint"))
    got = {r.seq: r.reason for r in pipeline.classify(df, TAXONOMY, scorer=models_used()).collect()}
    assert got == {0: "qwen2.5:7b", 1: "qwen2.5:14b"}


def test_routed_plan_gives_unreadable_rows_to_rules(spark):
    got = plan(spark, ["x.bin", "y.zip", "z.pdf", "image.png"], answering("Medical_Health"), pipeline.routed)
    assert (got["x.bin"].method, got["x.bin"].reason) == ("Prefilter", "no worker can read this file type and no rule matched")
    assert got["y.zip"].category == "Archives_and_Apps"
    assert (got["z.pdf"].category, got["z.pdf"].route) == ("Medical_Health", "ai-small")
    assert got["image.png"].category == "Media_Images"


def test_own_stage(spark):
    def by_size(df, taxonomy):
        return df, F.when(F.col("size_bytes") == 10, verdict("Customer_Data", 70, "size", "ten bytes"))

    got = plan(spark, ["a.pdf"], None, stages=[by_size, pipeline.RULES])
    assert (got["a.pdf"].category, got["a.pdf"].method) == ("Customer_Data", "size")


def test_unknown_route_has_no_stages():
    assert pipeline.stages_for("ocr") == pipeline.RULES_ONLY
    with pytest.raises(ValueError, match="unknown route"):
        pipeline.stages_for("elsewhere")


def test_routed_plan_refuses_unknown_routes(spark):
    rule = routing.RouteRule("elsewhere", F.col("ext") == ".pdf")
    with pytest.raises(ValueError, match="unknown route"):
        pipeline.routed(files(spark, ["a.pdf"]), TAXONOMY, routes=[rule])


def test_images_go_to_rules_even_with_their_own_route(spark):
    df = pipeline.routed(
        files(spark, ["image.png", "plain.png"]), TAXONOMY, scorer=answering("Medical_Health"), routes=routing.default_routes(images=True))
    got = {r.path[4:]: r for r in df.collect()}
    assert (got["image.png"].route, got["image.png"].category) == ("ocr", "Media_Images")
    assert (got["plain.png"].category, got["plain.png"].reason) == ("Unknown_Unsorted", "No classifier matched")


def test_repeated_replies_keep_one_row_per_file(spark):
    reply = '{"category":"Medical_Health","confidence":%d}'
    replies = spark.createDataFrame([("/in/a.pdf", reply % (90 - i), i) for i in range(50)], "path string, reply string, reply_seq long")
    rows = pipeline.classify(files(spark, ["a.pdf"]), TAXONOMY, replies=replies).collect()
    assert [(r.category, r.confidence) for r in rows] == [("Medical_Health", 90)]


def test_routes(spark):
    rows = [("a.pdf", 1024), ("b.csv", (2 << 20) + 10), ("c.pdf", 2 << 20), ("d.png", 3 << 20), ("e.bin", 5), ("f.txt", None), ("g", 1)]
    df = spark.createDataFrame(rows, "path string, size_bytes long")
    from filewright.operators import rules
    got = {r.path: r.route for r in routing.with_route(rules.with_names(df)).collect()}
    assert got == {"a.pdf": "ai-small", "b.csv": "ai-large", "c.pdf": "ai-large", "d.png": "unroutable", "e.bin": "unroutable",
                   "f.txt": "ai-small", "g": "unroutable"}
    assert [r.route for r in routing.describe(spark).collect()] == ["ai-large", "ai-small", "unroutable"]


@pytest.mark.parametrize("counts, want", [
    ({"ai-small": 92, "ai-large": 6, "ocr": 10, "unroutable": 26}, {"ai-small": 2, "ai-large": 1}),
    ({}, {"ai-small": 1, "ai-large": 1}), ({"ai-small": 25}, {"ai-small": 1, "ai-large": 1}),
    ({"ai-small": 26}, {"ai-small": 2, "ai-large": 1}),
])
def test_worker_counts(spark, counts, want):
    df = spark.createDataFrame(list(counts.items()), "route string, files long")
    assert {r.route: r.workers for r in routing.worker_counts(df, routing.capacity_table(spark)).collect()} == want


def test_model_settings(spark):
    def model(route, settings, override=None):
        return spark.range(1).select(routing.model_for_route(F.lit(route), settings, override)).first()[0]

    base = {"default_local_model": "d", "large_model": "l", "models": {"ai-small": "s"}}
    assert model("ai-small", base) == "s" and model("ai-large", base) == "l" and model("rules", base) == "d"
    assert model("ai-small", base, "mine") == "mine" and model("ai-small", base, "") == "s"
    assert model("ai-large", {"default_local_model": "d"}) == "d"
    assert model("ai-large", {**base, "models": {"ai-large": ""}}) == "l"


def test_no_python_without_a_scorer(spark):
    replies = spark.createDataFrame([("/in/a.pdf", "{}", 1)], "path string, reply string, reply_seq long")
    df = files(spark, ["a.pdf", "b.csv"])
    text = lambda plan: plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text(pipeline.classify(df, TAXONOMY, replies=replies))
    assert "Python" in text(pipeline.classify(df, TAXONOMY, scorer=answering("Medical_Health")))


def test_each_file_is_scored_once(spark, tmp_path):
    scored = spark.sparkContext.accumulator(0)

    def factory():
        def score(prompts, models):
            scored.add(len(prompts))
            return ['{"category":"Medical_Health","confidence":90}'] * len(prompts)

        return score

    listing = files(spark, [f"f{i}.pdf" for i in range(40)]).drop("seq")
    done = jobs.sort(listing, "/in", TAXONOMY, scorer=factory)
    assert done.summary.collect()[0].files == 40 and done.moves.count() == 40
    assert scored.value == 40


def test_columns_of_the_inventory_come_out_as_they_were(spark):
    df = files(spark, ["clinic visit.pdf", "x.bin"])
    for extra in (["flat"], ["ext", "name"], ["flat", "name", "note"]):
        own = df.withColumns({c: F.lit(f"own {c}") for c in extra})
        for run in (lambda d: pipeline.classify(d, TAXONOMY, pipeline.RULES_ONLY), lambda d: pipeline.routed(d, TAXONOMY), lambda d: pipeline.prefilter(d, TAXONOMY)):
            plan = run(own)
            assert [c for c in plan.columns if c != "route"] == [*own.columns, "category", "confidence", "method", "reason"]
            assert {tuple(r[c] for c in extra) for r in plan.collect()} == {tuple(f"own {c}" for c in extra)}
            assert {r.path: r.category for r in plan.collect()}["/in/clinic visit.pdf"] == "Medical_Health"
    with pytest.raises(ValueError, match="rename them first: category"):
        pipeline.classify(df.withColumn("category", F.lit("x")), TAXONOMY)
