"""Days replayed with predicted prep: corrected delays and moved blocks.

All of these take the surgical set with places (``surgical.with_places``) and a
``predicted_prep`` column, from the lookup or from a fitted model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import clip_low, occupied_or_default, within
from slotwise.operators import DAY, attach, ordered_list, sequence_days
from slotwise.session import cut

from .whatif import LOOKUP_KEYS, prep_lookup

DEFAULT_INOR = 35


def predict_by_lookup(placed: DataFrame, cases: DataFrame) -> DataFrame:
    lookup = prep_lookup(cases).select(*LOOKUP_KEYS, F.col("lookup_prep").alias("predicted_prep"))
    return attach(placed, lookup, LOOKUP_KEYS)


def corrected_days(predicted: DataFrame, whole: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """Start delays after the prep saved so far in the day is taken off.

    A case saves its predicted prep, at most its actual prep. With ``whole=False``
    only the part that was not planned anyway is saved.
    """
    saved = F.least("predicted_prep", "actual_prep_min")
    if not whole:
        saved = clip_low(saved - F.col("planned_prep_min"))
    rows = sequence_days(
        predicted.withColumn("benefit", saved), "ts_patient_in_or_planned",
        running={"cumulative_benefit": ("benefit", True)}, hot=hot,
    )
    return rows.withColumn(
        "corrected_delay", clip_low(F.col("start_delay_min") - F.col("cumulative_benefit"))
    )


def corrected_day(predicted: DataFrame, or_room: str, date: str, hot: DataFrame | None = None) -> DataFrame:
    day = (F.col("or_room") == or_room) & (F.col("date") == F.lit(date).cast("date"))
    return corrected_days(predicted.where(day), hot=hot)


def increasing_days(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Per room-day: do known start delays grow from each case to the next?"""
    known = rows.where(F.col("start_delay_min").isNotNull())
    steps = sequence_days(
        known, "ts_patient_in_or_planned", previous={"_before": "start_delay_min"}, hot=hot
    )
    grows = F.coalesce(F.min(F.col("start_delay_min") > F.col("_before")), F.lit(True))
    return steps.groupBy(*DAY).agg(F.count("*").alias("n_known"), grows.alias("increasing"))


def cascade_day_candidates(
    predicted: DataFrame,
    k: int = 10,
    *,
    since: str | None = None,
    min_first_gap: float = 15,
    max_first_error: float = 20,
    min_first_delay: float = 15,
    max_corrected: float = 20,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Days of ever later starts that predicted prep would have calmed.

    A day whose first case has a procedure that training has not seen
    (``procedure_code`` -1, where the rows have one) is left out.
    Lists of cases are built only for days that grow; their delays rise by whole
    minutes, so a list is short. Without split days the one exchange of the steps
    serves all that follows; split days are judged by aggregates, and the steps of
    the ``k`` days returned are read again.
    """
    rows = predicted.where(F.col("predicted_prep").isNotNull())
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since).cast("date"))
    rows = rows.withColumn("error", F.abs(F.col("actual_prep_min") - F.col("predicted_prep")))
    saved = F.least("predicted_prep", "actual_prep_min")
    steps = sequence_days(
        rows.withColumn("benefit", saved), "ts_patient_in_or_planned",
        previous_known={"_before": "start_delay_min"},
        running={"_saved": ("benefit", True)}, hot=hot,
    ).withColumn("corrected_delay", clip_low(F.col("start_delay_min") - F.col("_saved")))
    coded = "procedure_code" in steps.columns
    steps = steps.select(
        *DAY, "position", "procedure_name", "start_delay_min", "_before", "prep_gap_min", "error",
        "planned_prep_min", "actual_prep_min", "predicted_prep", "corrected_delay",
        *(["procedure_code"] if coded else []),
    )
    first = F.col("position") == 1
    delay = F.col("start_delay_min")

    def of_first(column: str) -> Column:
        return F.max(F.when(first, F.col(column)))

    judged = {
        "n_cases": F.count("*"),
        "max_corrected": F.max("corrected_delay"),
        "_grows": F.min(delay > F.col("_before")),
        "_gap": of_first("prep_gap_min"),
        "_error": of_first("error"),
        "_delay": of_first("start_delay_min"),
        **({"_first_code": of_first("procedure_code")} if coded else {}),
    }
    wanted = (
        (F.col("n_cases") >= 2)
        & F.col("_grows")
        & (F.col("_gap") >= min_first_gap)
        & (F.col("_error") <= max_first_error)
        & (F.col("_delay") >= min_first_delay)
        & (F.round("max_corrected", 1) <= max_corrected)
    )
    if coded:
        wanted = wanted & (F.coalesce("_first_code", F.lit(0)) != -1)
    told = {"mean_error": F.avg("error"), "cascade": F.max(delay) - F.min(delay)}
    best = [F.col("n_procedures").desc(), F.col("cascade").desc(), F.col("date"), F.col("or_room")]
    fields = ["procedure_name", "start_delay_min", "planned_prep_min", "actual_prep_min",
              "predicted_prep", "corrected_delay"]
    result = [*DAY, *[f"{f}_list" for f in fields], "n_cases", "n_procedures", *told, "max_corrected"]
    if hot is None:
        day = Window.partitionBy(*DAY)
        rows = steps.withColumns({n: c.over(day) for n, c in judged.items()}).where(wanted)
        packed = F.array_sort(F.collect_list(F.struct("position", *fields)))
        days = rows.groupBy(*DAY).agg(
            packed.alias("_rows"), F.max("n_cases").alias("n_cases"), F.max("max_corrected").alias("max_corrected"),
            *[c.alias(n) for n, c in told.items()])
        days = days.withColumns({f"{f}_list": F.col(f"_rows.{f}") for f in fields}).withColumn(
            "n_procedures", F.size(F.array_distinct(F.array_compact("procedure_name_list"))).cast("long"))
        return days.orderBy(*best).limit(k).select(*result)
    # Judging and listing both read the steps; they are made once.
    steps = cut(steps)
    days = steps.groupBy(*DAY).agg(
        *[c.alias(n) for n, c in {**judged, **told}.items()], F.countDistinct("procedure_name").alias("n_procedures")
    ).where(wanted)
    chosen = days.orderBy(*best).limit(k).select(*DAY, "n_cases", "n_procedures", *told, "max_corrected")
    # At most k days.
    lists = ordered_list(
        steps.join(F.broadcast(chosen.select(*DAY)), list(DAY), "left_semi"), DAY, "position", fields
    )
    return lists.join(F.broadcast(chosen), list(DAY)).select(*result)


def replay_days(
    predicted: DataFrame, use_predicted: bool = False, default_inor: float = DEFAULT_INOR,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Cases of a day laid end to end, once as allocated and once as they happened.

    Gives both starts, how much of prep and surgery lay inside and outside the
    allocation, and the minutes late. A stay without a length takes ``default_inor``.
    """
    planned = "predicted_prep" if use_predicted else "planned_prep_min"
    actual_prep = F.col("actual_prep_min").cast("double")
    blocks = predicted.withColumns({
        "alloc_prep": F.greatest(F.col(planned).cast("double"), F.lit(0.0)),
        "alloc_inor": occupied_or_default(F.col("planned_inor_min").cast("double"), default_inor),
        "real_inor": occupied_or_default(F.col("actual_inor_min").cast("double"), default_inor),
    }).withColumns({
        "_alloc": F.col("alloc_prep") + F.col("alloc_inor"),
        "_real": occupied_or_default(actual_prep, 0.0) + F.col("real_inor"),
    })
    rows = sequence_days(
        blocks, "ts_patient_in_or_planned",
        running={"alloc_start": ("_alloc", False), "actual_start": ("_real", False)}, hot=hot,
    )
    prep_within = F.least(actual_prep, F.col("alloc_prep"))
    surgery_from = F.col("actual_start") + actual_prep
    alloc_end = F.col("alloc_start") + F.col("_alloc")
    inor_within = clip_low(F.least(F.col("real_inor"), alloc_end - surgery_from), 0.0)
    return rows.select(
        *DAY, "position", "case_id", "procedure_name", "alloc_start", "alloc_prep", "alloc_inor",
        "actual_start",
        prep_within.alias("prep_within"),
        clip_low(actual_prep - F.col("alloc_prep"), 0.0).alias("prep_outside"),
        inor_within.alias("inor_within"),
        clip_low(F.col("real_inor") - inor_within, 0.0).alias("inor_outside"),
        (F.col("actual_start") - F.col("alloc_start")).alias("minutes_late"),
        (surgery_from + F.col("real_inor")).alias("finish"),
    )


def waiting_saved(predicted: DataFrame, since: str, until: str, hot: DataFrame | None = None) -> DataFrame:
    """Waiting in a test window before and after the predicted prep is planned."""
    window = within(F.col("date"), (F.lit(since).cast("date"), F.lit(until).cast("date")))
    rows = corrected_days(predicted.where(window), hot=hot).where(F.col("corrected_delay").isNotNull())
    before, after = clip_low(F.col("start_delay_min")), F.col("corrected_delay")
    return rows.agg(
        F.count("*").alias("n_cases"),
        F.sum(before).alias("minutes_before"),
        F.sum(after).alias("minutes_after"),
        ((F.sum(before) - F.sum(after)) / 60.0).alias("hours_saved"),
        F.avg(before - after).alias("mean_saved"),
    )
