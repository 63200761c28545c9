"""Three-valued roll-ups of judge verdicts: symptom hits to rubrics, rubrics to trials.

A null verdict means "does not apply" and is skipped by any and every; a group without
verdicts stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip

NO_INCIDENT = "(no_incident)"
EMPTY_REPORT = "empty_report"


def any_of(x: Column) -> Column:
    return F.bool_or(x)


def all_of(x: Column) -> Column:
    return F.bool_and(x)


def any_or_false(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def all_or_false(x: Column) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(False))


def hallucinated(mode: Column, n_rubrics: Column, only_flag: Column, any_match: Column) -> Column:
    """Null for a single rubric of no incident, false for an empty report, else whether no rubric was matched."""
    return (
        F.when((n_rubrics == 1) & (only_flag == NO_INCIDENT), F.lit(None).cast("boolean"))
        .when(mode == EMPTY_REPORT, F.lit(False))
        .otherwise(~F.coalesce(any_match, F.lit(False)))
    )


def reward(depth: Column) -> Column:
    """Mean rubric score (0 to 3) as a share; no rubric, no reward."""
    return F.coalesce(depth, F.lit(0.0)) / 3


def string_match_score(report: Column, cause: Column, is_control: Column) -> Column:
    """3 or 0: the report names the cause; of a control, the report is blank."""
    body = F.coalesce(report, F.lit(""))
    named = F.contains(F.lower(body), F.lower(strip(cause)))
    return F.when(F.when(is_control, strip(body) == "").otherwise(F.coalesce(named, F.lit(False))), F.lit(3)).otherwise(F.lit(0))


def override(disqualified: Column, credited: Column, verdict: Column) -> Column:
    """A trial's reward after appeals: a disqualified one has none, a credited one all."""
    return F.when(disqualified, F.lit(0.0)).when(credited, F.lit(1.0)).otherwise(verdict)


def hits_all(hits: Column) -> Column:
    """Whether all cluster hits of a rubric hold; null without clusters. A hit that is null is a miss."""
    return F.when(F.size(hits) > 0, F.forall(hits, lambda x: F.coalesce(x, F.lit(False))))


def hits_any(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.exists(hits, lambda x: F.coalesce(x, F.lit(False))))


def cluster_hits(symptoms: Column) -> dict[str, Column]:
    """Hits of a rubric's clusters by kind: a log must be met in body and service, a trace in its chain and its smoking gun."""
    truth = lambda x: F.coalesce(x, F.lit(False))
    none = F.array().cast("array<boolean>")
    return {
        "metrics": F.coalesce(F.transform(symptoms["metrics"], lambda m: truth(m["family_match"])), none),
        "logs": F.coalesce(F.transform(symptoms["logs"], lambda x: truth(x["body_match"]) & truth(x["service_name_match"])), none),
        "traces": F.coalesce(F.transform(symptoms["traces"], lambda x: truth(x["call_chain_match"]) & truth(x["smoking_gun_match"])), none),
    }


def checked_score(x: Column) -> Column:
    """A rubric's score as a whole number from 0 to 3; anything else stops the job."""
    stop = F.raise_error(F.concat(F.lit("rubric score outside 0 to 3: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("int")
    return F.when(x.between(0, 3), x.cast("int")).otherwise(stop)


def blank_verdict(rubric: Column) -> Column:
    """What an empty report is judged: nothing matched, as many clusters as the rubric lists, score 0."""
    no = F.lit(False)
    symptoms = rubric["symptoms"]
    return F.struct(
        F.coalesce(rubric["feature_flag"], F.lit("")).alias("feature_flag"),
        no.alias("incident_time_within_10min"),
        no.alias("feature_flag_match"),
        no.alias("mechanism_match"),
        F.struct(
            F.transform(symptoms["metrics"], lambda m: F.struct(m["metric_family"].alias("metric_family"), no.alias("family_match"))).alias("metrics"),
            F.transform(symptoms["logs"], lambda _: F.struct(no.alias("body_match"), no.alias("service_name_match"))).alias("logs"),
            F.transform(symptoms["traces"], lambda _: F.struct(no.alias("call_chain_match"), no.alias("smoking_gun_match"))).alias("traces"),
        ).alias("symptoms"),
        F.lit(0).alias("score"),
    )


def reward_map(reward: Column, rca_accuracy: Column, hallucinate_any: Column) -> Column:
    """The numbers a verifier writes, by name: the reward, and of the others those that are known."""
    pairs = F.create_map(F.lit("reward"), reward.cast("double"), F.lit("rca_accuracy"), rca_accuracy.cast("int").cast("double"), F.lit("hallucinate_any"), hallucinate_any.cast("int").cast("double"))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def detected(wrote_report: Column, is_control: Column) -> Column:
    """100 where a report was written exactly if there was an incident, else 0."""
    return F.when(wrote_report == ~is_control, F.lit(100)).otherwise(F.lit(0))
