"""The model stage: prompt -> reply -> accepted verdict.

A scorer runs as a vectorised UDF over one column of prompts. Rows that need no
score carry a NULL prompt: they stay in the JVM apart from that NULL, so a plan
reads its input once instead of once for each branch.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.config import Taxonomy
from filewright.functions import replies as R
from filewright.functions import text as X
from filewright.functions.verdicts import accept, unknown
from filewright import constants as C

# Built once per Python worker; takes prompts and model names, returns replies.
Scorer = Callable[[list[str], list[str]], list[str]]
ScorerFactory = Callable[[], Scorer]


def scorer_udf(factory: ScorerFactory):
    """UDF (prompt, model) -> struct<reply, error> around a scorer factory.

    One bad prompt spoils neither its batch nor its task: when a batch fails,
    its prompts are tried one by one.
    """

    def answer(score, prompts: list, models: list) -> list[tuple]:
        try:
            answers = list(score(prompts, models))
            if len(answers) == len(prompts):
                return [(a, None) for a in answers]
        except Exception:
            pass
        out = []
        for prompt, model in zip(prompts, models):
            try:
                out.append((list(score([prompt], [model]))[0], None))
            except Exception as exc:
                out.append((None, f"{type(exc).__name__}: {exc}"))
        return out

    @F.pandas_udf("reply string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        score = None
        for prompts, models in batches:
            replies, errors = [None] * len(prompts), [None] * len(prompts)
            wanted = prompts.notna().to_numpy().nonzero()[0]
            if len(wanted):
                score = score or factory()
                pairs = answer(score, prompts.iloc[wanted].tolist(), models.iloc[wanted].tolist())
                for position, (reply, error) in zip(wanted, pairs):
                    replies[position], errors[position] = reply, error
            yield pd.DataFrame({"reply": replies, "error": errors}, dtype=object)

    return run


def with_score(df: DataFrame, factory: ScorerFactory, prompt: str, model: str, tasks: int | None = None) -> DataFrame:
    """Add ``reply`` and ``error``. ``tasks`` spreads the rows evenly first, for
    scorers so slow that an even load is worth a shuffle."""
    if tasks:
        df = df.repartition(tasks)
    answered = df.withColumn("_answer", scorer_udf(factory)(F.col(prompt), F.col(model)))
    return answered.withColumns({"reply": F.col("_answer.reply"), "error": F.col("_answer.error")}).drop("_answer")


def needs_score(settled: Column, snippet: Column) -> Column:
    """Rows without a verdict so far and with something to read."""
    return settled.isNull() & ~X.is_blank(snippet)


def model_verdict(reply: Column, taxonomy: Taxonomy, threshold: int | None = None, error: Column | None = None) -> Column:
    """Accepted verdict of a reply, NULL where the model declines or failed."""
    answer = R.parse_reply(reply, taxonomy.names)
    if error is not None:
        answer = F.when(error.isNotNull(), unknown(error, C.METHOD_MODEL)).otherwise(answer)
    return accept(answer, taxonomy.threshold if threshold is None else threshold)


def with_reply_table(df: DataFrame, replies: DataFrame, wanted: Column, key: str = "path") -> DataFrame:
    """Add ``reply`` from a table of earlier replies, for the ``wanted`` rows.

    The first reply per key counts; it is picked by a partial aggregate, so a
    key that repeats a billion times reaches the join as one row per task.
    """
    order = F.col("reply_seq") if "reply_seq" in replies.columns else F.col("reply")
    first = replies.groupBy(F.col(key).alias("_key")).agg(F.min_by("reply", order).alias("reply"))
    return df.join(first, wanted & (F.col(key) == F.col("_key")), "left").drop("_key")
