"""Prompt tables out, reply tables in.

The generating service itself is outside: a prompt table goes to it, a reply table (prompt id, status, raw
text, error) comes back and is joined here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.replies import reply_feedback, reply_score, score_band
from matchloom.functions.text import trim_u, truncate


def bullets(passages: Column) -> Column:
    lines = F.array_join(F.transform(passages, lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.when(F.size(passages) > 0, lines).otherwise(F.lit(V.NO_EVIDENCE))


def _posting_and_evidence(job: Column, matched: Column) -> list[Column]:
    return [
        F.lit(V.HEAD_JOB), truncate(job, V.SCREEN_JOB_CHARS),
        F.lit(V.HEAD_EVIDENCE), bullets(matched),
    ]


def screen_prompt(resume: Column, job: Column, matched: Column) -> Column:
    return F.concat(
        *_posting_and_evidence(job, matched),
        F.lit(V.HEAD_RESUME), truncate(resume, V.SCREEN_RESUME_CHARS),
        F.lit("\n\n" + V.SCREEN_TASK),
    )


def tailor_prompt(resume: Column, job: Column, matched: Column) -> Column:
    return F.concat(
        *_posting_and_evidence(job, matched),
        F.lit(V.HEAD_CURRENT_RESUME), truncate(resume, V.TAILOR_RESUME_CHARS),
        F.lit("\n\n" + V.TAILOR_TASK),
    )


def fit_prompt(role: Column, resume: Column, matched: Column) -> Column:
    """Null when nothing was retrieved: such a request is answered without a prompt."""
    prompt = F.concat(
        F.lit(V.HEAD_ROLE), role,
        F.lit(V.HEAD_REQUIREMENTS), bullets(matched),
        F.lit(V.HEAD_RESUME), truncate(resume, V.FIT_RESUME_CHARS),
        F.lit("\n\n" + V.FIT_TASK),
    )
    return F.when(F.size(matched) > 0, prompt)


def system(prompt: Column, text: str) -> Column:
    """The fixed instructions that go with a prompt; null where there is no prompt."""
    return F.when(prompt.isNotNull(), F.lit(text)).alias("system")


def join_replies(prompts: DataFrame, replies: DataFrame, prompt: str) -> DataFrame:
    """Adds `status`, `raw`, `problem`; a prompt without a reply counts as one without a key."""
    r = replies.select(prompt, F.col("status"), F.col("raw"), F.col("problem"))
    return prompts.join(r, prompt, "left").withColumn("status", F.coalesce("status", F.lit(V.STATUS_NO_KEY)))


def _failure(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce("problem", F.lit("")))


def _is(status: str) -> Column:
    return F.col("status") == status


def screen_result(joined: DataFrame) -> DataFrame:
    """Adds `score`, `needs_key`, `feedback`, the band and what is to be shown."""
    ok = _is(V.STATUS_OK)
    feedback = (
        F.when(ok, reply_feedback(F.col("raw")))
        .when(_is(V.STATUS_NO_KEY), F.lit(V.MSG_SCREEN_NO_KEY))
        .when(_is(V.STATUS_REJECTED), F.lit(V.MSG_REJECTED))
        .otherwise(_failure(V.MSG_SCREEN_FAILED))
    )
    out = joined.withColumns({"score": F.when(ok, reply_score(F.col("raw"))), "needs_key": ~ok, "feedback": feedback})
    return out.withColumns({
        "band": score_band(F.col("score")),
        "show_score": F.col("score").isNotNull(),
        "show_feedback": F.col("feedback") != "",
        "show_matched": F.col("needs_key") & (F.size("matched") > 0),
    })


def tailor_result(joined: DataFrame) -> DataFrame:
    text = (
        F.when(_is(V.STATUS_NO_KEY), F.lit(V.MSG_TAILOR_NO_KEY))
        .when(_is(V.STATUS_OK), trim_u(F.col("raw")))
        .when(_is(V.STATUS_REJECTED), F.lit(V.MSG_REJECTED))
        .otherwise(_failure(V.MSG_TAILOR_FAILED))
    )
    return joined.withColumn("tailored", text)


def fit_result(joined: DataFrame) -> DataFrame:
    """Nothing retrieved comes first, before the key is looked at."""
    text = (
        F.when(F.size("matched") == 0, F.concat(F.lit(V.MSG_FIT_NO_PASSAGES), F.col("role"), F.lit(".")))
        .when(_is(V.STATUS_NO_KEY), F.lit(V.MSG_FIT_NO_KEY))
        .when(_is(V.STATUS_OK), F.col("raw"))
        .when(_is(V.STATUS_REJECTED), F.lit(V.MSG_FIT_REJECTED))
        .when(_is(V.STATUS_RATE_LIMITED), F.lit(V.MSG_FIT_RATE_LIMITED))
        .otherwise(_failure(V.MSG_FIT_FAILED))
    )
    return joined.withColumn("analysis", text)
