"""Stages as DataFrame functions, and the state of what goes through them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.amounts import retry_at

OUTCOME = "struct<tag:string,note:string,reason:string,error_class:string,retryable:boolean>"


@dataclass(frozen=True)
class Stage:
    """A step from one state to the next. apply gets the rows that are in `consumes` and adds `outcome`."""

    number: int
    name: str
    consumes: str
    produces: str
    apply: Callable[[DataFrame], DataFrame]


def validated(stages: Sequence[Stage]) -> Sequence[Stage]:
    """The stages, if each begins where the one before ends, numbers rise, and the last state is terminal."""
    for a, b in zip(stages, stages[1:], strict=False):
        if a.produces != b.consumes:
            raise ValueError(f"{b.name} begins at {b.consumes}, but {a.name} ends at {a.produces}")
        if a.number >= b.number:
            raise ValueError(f"{b.name} must have a higher number than {a.name}")
    if not stages or stages[-1].produces not in fixed.TERMINAL:
        raise ValueError("the last stage must end in a terminal state")
    return stages


def is_terminal(status: Column) -> Column:
    return status.isin(*fixed.TERMINAL)


def runnable(rows: DataFrame, now: Column, states: Sequence[str] = fixed.STATES[:-1]) -> DataFrame:
    """Rows that a stage may take: in a state that one consumes, with attempts left, and not waiting."""
    due = F.col("retry_after").isNull() | (F.col("retry_after") <= now)
    return rows.filter(F.col("status").isin(*states) & (F.col("attempts") < fixed.MAX_ATTEMPTS) & due)


def progress(status: Column) -> Column:
    places = F.create_map(*[F.lit(x) for i, s in enumerate(fixed.STATES) for x in (s, i)])
    return F.coalesce(F.try_element_at(places, status), F.lit(-1))


def pick_order(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows furthest along first, then the longest untouched. With a limit the head of the queue alone, without a full sort."""
    ordered = rows.orderBy(progress(F.col("status")).desc(), "updated_at", "id")
    return ordered.limit(limit) if limit is not None else ordered


def moved(rows: DataFrame, produces: str, now: Column) -> DataFrame:
    """rows after their outcome: advanced to `produces`, rejected, to be tried again later, or dead."""
    tag = F.col("outcome.tag")
    failed = tag == "failed"
    attempts = F.when(failed, F.col("attempts") + 1).when(tag == "advanced", F.lit(0)).otherwise(F.col("attempts"))
    dead = failed & (~F.coalesce(F.col("outcome.retryable"), F.lit(True)) | (F.col("attempts") + 1 >= fixed.MAX_ATTEMPTS))
    return rows.withColumns(
        {
            "status": F.when(tag == "advanced", produces).when(tag == "rejected", "rejected").when(dead, "dead").otherwise(F.col("status")),
            "status_reason": F.coalesce("outcome.reason", "outcome.note"),
            "retry_after": F.when(failed & ~dead, retry_at(now, F.col("attempts") + 1)),
            "attempts": attempts,
            "updated_at": now,
        }
    )


def dead_letters(rows: DataFrame, stage: str) -> DataFrame:
    """The rows that died in a stage, as a side output."""
    return rows.filter("status = 'dead'").select("id", F.lit(stage).alias("stage"), F.col("outcome.error_class").alias("error_class"), F.col("status_reason").alias("message"), "attempts")


def letters_beside(letters: DataFrame, attachments: DataFrame) -> DataFrame:
    """Dead letters (id, attachment_id and more) beside the attachments (id, filename) that they are of, the newest first. A letter whose
    attachment isn't there is left out."""
    named = attachments.select(F.col("id").alias("attachment_id"), "filename")
    return letters.join(named, "attachment_id").orderBy(F.desc("id"))


def run_stage(rows: DataFrame, stage: Stage, now: Column) -> tuple[DataFrame, DataFrame]:
    """The whole table after one stage, and its dead letters. Rows that the stage doesn't take stay as they are."""
    due = runnable(rows, now, [stage.consumes])
    after = moved(stage.apply(due), stage.produces, now)
    rest = rows.join(due.select("id"), "id", "left_anti")
    return rest.unionByName(after.select(*rows.columns)), dead_letters(after, stage.name)


def run_all(rows: DataFrame, stages: Sequence[Stage], now: Column) -> DataFrame:
    """One pass of all stages: what would take as many transitions one by one is one plan."""
    for stage in validated(stages):
        rows, _ = run_stage(rows, stage, now)
    return rows


def replay(rows: DataFrame, ids: DataFrame, stage: Stage, now: Column, force: bool = False) -> DataFrame:
    """The given rows through one stage again; terminal ones only if forced."""
    again = rows.join(ids, "id", "left_semi")
    again = again if force else again.filter(~is_terminal(F.col("status")))
    return moved(stage.apply(again), stage.produces, now)


def revived(rows: DataFrame, letters: DataFrame, consumes: dict[str, str]) -> DataFrame:
    """Dead rows set back to the state before the stage that they died in."""
    states = F.create_map(*[F.lit(x) for pair in consumes.items() for x in pair])
    back = letters.groupBy("id").agg(F.max_by("stage", "attempts").alias("_stage"))
    joined = rows.join(back, "id", "left")
    dead = (F.col("status") == "dead") & F.col("_stage").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(dead, F.try_element_at(states, F.col("_stage"))).otherwise(F.col("status")),
            "attempts": F.when(dead, 0).otherwise(F.col("attempts")),
            "retry_after": F.when(~dead, F.col("retry_after")),
        }
    ).drop("_stage")


def drained(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows changed their status, and how many of them ended."""
    both = before.select("id", F.col("status").alias("was")).join(after.select("id", "status"), "id").filter(~F.col("was").eqNullSafe(F.col("status")))
    return both.agg(F.count(F.lit(1)).alias("transitions"), F.count(F.when(is_terminal(F.col("status")), 1)).alias("ended"))
