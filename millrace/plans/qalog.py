"""The log of questions and answers: labels, issues and when to look at them again."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import upsert

#: How answers are labelled.
GOOD, BAD, UNKNOWN = ("good", "good_case", "goodcase"), ("bad", "bad_case", "badcase"), "unknown"


def label_of(x: Column) -> Column:
    """good, bad or unknown."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(low.isin(*GOOD), "good").when(low.isin(*BAD), "bad").otherwise(UNKNOWN)


def totals(log: DataFrame) -> DataFrame:
    label = label_of(F.col("label"))
    return log.select(label.alias("l")).agg(F.count("*").alias("total"), F.count_if(F.col("l") == "good").alias("good"), F.count_if(F.col("l") == "bad").alias("bad"))


def top_issues(log: DataFrame, n: int = 12, seq: str = "seq") -> DataFrame:
    """issue and how many bad rows' lists hold it, most frequent first, then first seen."""
    empty = F.array().cast("array<string>")
    issues = F.concat(F.coalesce("issues", empty), F.coalesce("feedback.issues", empty))
    bad = log.where(label_of(F.col("label")) == "bad").select(F.col(seq).alias("s"), F.posexplode(issues).alias("p", "issue")).where(F.trim("issue") != "")
    return bad.groupBy(F.trim("issue").alias("issue")).agg(F.count("*").alias("n"), F.min(F.struct("s", "p")).alias("first")).orderBy(F.desc("n"), "first").limit(n).drop("first")


def advice(issues: DataFrame, answers: Mapping[str, str]) -> DataFrame:
    """What to ask or to heed for the issues, each sentence once, in order of the issues."""
    table = F.create_map(*(F.lit(x) for kv in answers.items() for x in kv)) if answers else F.create_map().cast("map<string,string>")
    found = issues.withColumn("advice", F.try_element_at(table, F.col("issue"))).where("advice IS NOT NULL")
    return found.groupBy("advice").agg(F.max("n").alias("n"), F.min("issue").alias("issue")).orderBy(F.desc("n"), "issue")


def pairs(x: Column) -> Column:
    """k=v texts as a map; a text without = is an error."""
    checked = F.when(F.forall(x, lambda s: F.contains(s, F.lit("="))), x).otherwise(F.raise_error(F.lit("k=v expected")).cast("array<string>"))
    return F.map_from_entries(F.transform(checked, lambda s: F.struct(F.regexp_extract(s, r"^([^=]*)=", 1).alias("key"), F.regexp_extract(s, r"^[^=]*=(?s)(.*)$", 1).alias("value"))))


def update(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the log by id with changes in place; unknown ids are added."""
    return upsert(log, changes, "id")


def due(log: DataFrame, seen_before: int, least: int = 20) -> tuple[bool, int]:
    """Whether the log has ``least`` labelled rows, and as many new ones since the last look; and how many there are."""
    labelled = log.where(label_of(F.col("label")) != UNKNOWN).count()
    return labelled >= least and labelled - seen_before >= least, labelled


def summary(log: DataFrame, updated_at: str, seq: str = "seq") -> str:
    """Totals and top issues as JSON."""
    facts = totals(log).first().asDict()
    return json.dumps(facts | {"top_issues_bad": [(r["issue"], r["n"]) for r in top_issues(log, seq=seq).collect()], "updated_at": updated_at}, ensure_ascii=False)
