"""Classification plans: ordered stages, first known verdict wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.config import Taxonomy
from filewright.functions import replies as R
from filewright.functions import text as X
from filewright.functions.verdicts import first_known, unknown
from filewright.operators import routing, rules, scoring
from filewright.sources.previews import has_text, with_snippet

# A stage of one's own: adds what it needs and returns (frame, verdict column).
Stage = Callable[[DataFrame, Taxonomy], tuple[DataFrame, Column]]

MARKERS, MODEL, RULES = "markers", "model", "rules"
LOCAL = (MARKERS, MODEL, RULES)
RULES_ONLY = (MARKERS, RULES)
# Scoring routes ask the model, the others use file-name rules alone.
STAGES_BY_ROUTE = {
    C.ROUTE_SMALL: LOCAL,
    C.ROUTE_LARGE: LOCAL,
    C.ROUTE_RULES: RULES_ONLY,
    C.ROUTE_IMAGE: RULES_ONLY,
}


def stages_for(route: str) -> tuple[str, ...]:
    if route not in STAGES_BY_ROUTE:
        raise ValueError(f"unknown route: {route!r}")
    return STAGES_BY_ROUTE[route]


NAMED = ("name", "ext", "flat")
VERDICT_NAMES = ("category", "confidence", "method", "reason")


def _prepare(files: DataFrame) -> DataFrame:
    """``files`` with ``NAMED``. One that has all three brings them on purpose; otherwise its own columns of these names are
    put aside and come out again as they were. Columns with names of a verdict are refused."""
    clash = [c for c in VERDICT_NAMES if c in files.columns]
    if clash:
        raise ValueError(f"a plan adds columns of these names, rename them first: {', '.join(clash)}")
    if set(NAMED) <= set(files.columns):
        return files
    return rules.with_names(files.withColumns({f"_own_{c}": F.col(c) for c in NAMED if c in files.columns}))


def with_model(
    df: DataFrame, taxonomy: Taxonomy, scorer: scoring.ScorerFactory | None = None,
    replies: DataFrame | None = None, settled: Column | None = None, where: Column | None = None,
    threshold: int | None = None, model_override: str | None = None, tasks: int | None = None,
    out: str = "model",
) -> DataFrame:
    """Add the model stage's verdict for rows not ``settled`` and with text."""
    if (scorer is None) == (replies is None):
        raise ValueError("the model stage needs either a scorer or a table of replies")
    settled = F.lit(None) if settled is None else settled
    readable = ~X.is_blank(F.col("snippet")) if "snippet" in df.columns else has_text(taxonomy.max_chars)
    wanted = settled.isNull() & readable
    if where is not None:
        wanted = wanted & where
    added: list[str] = []
    if replies is not None:
        # One flag crosses the join's shuffle in place of the text it came from; no snippet is made.
        df = df.withColumn("_wanted", wanted)
        df = scoring.with_reply_table(df, replies, F.col("_wanted"))
        df = df.withColumn("_error", F.lit(None).cast("string"))
    else:
        added = [c for c in ("snippet", "route") if c not in df.columns]
        df = df if "snippet" in df.columns else with_snippet(df, taxonomy.max_chars)
        df = df if "route" in df.columns else routing.with_route(df)
        prompt = R.build_prompt(F.col("name"), F.col("snippet"), taxonomy.names)
        df = df.withColumns({
            "_prompt": F.when(wanted, prompt),
            "_model": F.when(wanted, routing.model_for_route(F.col("route"), taxonomy.settings, model_override)),
        })
        df = scoring.with_score(df, scorer, "_prompt", "_model", tasks).withColumnRenamed("error", "_error")
    # No reply row at all means the stage was not asked.
    asked = F.col("reply").isNotNull() | F.col("_error").isNotNull()
    answer = scoring.model_verdict(F.col("reply"), taxonomy, threshold, F.col("_error"))
    return df.withColumn(out, F.when(asked, answer)).drop(
        "reply", "_error", "_prompt", "_model", "_wanted", *added)


def classify(
    files: DataFrame, taxonomy: Taxonomy, stages: Sequence[str | Stage] = LOCAL,
    scorer: scoring.ScorerFactory | None = None, replies: DataFrame | None = None, **model_options,
) -> DataFrame:
    """``files`` with the columns category, confidence, method and reason.

    ``stages`` is tried in order. The model stage is left out where there is
    neither a scorer nor a table of replies; what it does not need to look at
    (rows an earlier stage settled) it is never given.
    """
    df = _prepare(files)
    verdicts: list[Column] = []
    added: list[str] = []
    for position, stage in enumerate(stages):
        out = f"_stage{position}"
        if stage == MARKERS:
            df = rules.with_markers(df, taxonomy, out)
        elif stage == RULES:
            df = rules.with_rules(df, taxonomy, out, _settled(verdicts))
        elif stage == MODEL:
            if scorer is None and replies is None:
                continue
            df = with_model(df, taxonomy, scorer, replies, _settled(verdicts), out=out, **model_options)
        else:
            df, column = stage(df, taxonomy)
            df = df.withColumn(out, column)
        verdicts.append(F.col(out))
        added.append(out)
    df = df.withColumn("_verdict", first_known(*verdicts)).drop(*added)
    return _flatten(df, files.columns)


def _settled(verdicts: Sequence[Column]) -> Column | None:
    """The first known verdict so far, NULL where there is none yet."""
    return F.coalesce(*[F.when(v["category"] != C.UNKNOWN, v) for v in verdicts]) if verdicts else None


def _flatten(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    own = [F.col(f"_own_{c}").alias(c) if f"_own_{c}" in df.columns else F.col(c) for c in columns]
    return df.select(*own, "_verdict.*")


def prefilter(files: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """File-name rules alone, for rows no scorer can read."""
    df = rules.with_rules(
        rules.with_markers(_prepare(files), taxonomy, "_marker"), taxonomy, "_rules", F.col("_marker"))
    verdict = F.coalesce("_marker", "_rules", unknown(C.REASON_PREFILTER, C.METHOD_PREFILTER))
    return _flatten(df.withColumn("_verdict", verdict), files.columns)


def routed(
    files: DataFrame, taxonomy: Taxonomy, scorer: scoring.ScorerFactory | None = None,
    replies: DataFrame | None = None, routes: Sequence[routing.RouteRule] | None = None, **model_options,
) -> DataFrame:
    """Both branches of a routed run in one pass over the input.

    Rows of scoring routes go through markers, model and rules. Rows nothing
    can read get rules alone and their own reason when none applies. A route
    without stages is an error.
    """
    for rule in routes or ():
        if rule.route != C.ROUTE_NONE:
            stages_for(rule.route)
    df = routing.with_route(_prepare(files), routes)
    df = rules.with_markers(df, taxonomy, "_marker")
    model = F.lit(None)
    if scorer is not None or replies is not None:
        asks = F.col("route").isin([r for r, s in STAGES_BY_ROUTE.items() if MODEL in s])
        df = with_model(df, taxonomy, scorer, replies, F.col("_marker"), asks, out="_answer", **model_options)
        model = F.col("_answer")
    settled = F.coalesce("_marker", model)
    df = rules.with_rules(df, taxonomy, "_rules", settled)
    none = F.when(F.col("route") == C.ROUTE_NONE, unknown(C.REASON_PREFILTER, C.METHOD_PREFILTER)).otherwise(unknown())
    parts = [settled, F.col("_rules"), none]
    columns = [*files.columns, *([] if "route" in files.columns else ["route"])]
    return _flatten(df.withColumn("_verdict", F.coalesce(*parts)), columns)


def prefilter_hits(plan: DataFrame) -> DataFrame:
    """Rows the rules-only branch handled, and how many it could name."""
    known = F.col("category") != C.UNKNOWN
    return plan.where(F.col("route") == C.ROUTE_NONE).agg(
        F.count("*").alias("total"), F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"))


def category_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("category").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "category")
