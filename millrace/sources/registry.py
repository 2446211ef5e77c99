"""The registry of news sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SOURCE


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if text.lstrip("-").isdigit() else text


def parse_yaml(text: str) -> dict:
    """Maps, lists and plain values by indentation: as much YAML as registries use, where the yaml package is absent."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    lines = [(len(line) - len(line.lstrip()), line.strip()) for line in text.splitlines() if line.strip() and not line.strip().startswith(("#", "---"))]
    lines = [(d, s.split(" #")[0].rstrip()) for d, s in lines]

    def block(at: int, depth: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("-"):
                item = lines[at][1][1:].strip()
                key, colon, _ = item.partition(":")
                if colon and " " not in key and "//" not in item[len(key) : len(key) + 3]:
                    lines[at] = (depth + 2, item)
                    value, at = block(at, depth + 2)
                else:
                    value, at = _scalar(item), at + 1
                out.append(value)
            return out, at
        made = {}
        while at < len(lines) and lines[at][0] == depth and not lines[at][1].startswith("- "):
            key, _, rest = lines[at][1].partition(":")
            at += 1
            if rest.strip():
                made[key.strip()] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("-")):
                made[key.strip()], at = block(at, lines[at][0])
            else:
                made[key.strip()] = None
        return made, at

    return block(0, lines[0][0])[0] if lines else {}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a YAML file, or of all such files of a folder, as a table."""
    return sources_of(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def sources_of(documents: DataFrame) -> DataFrame:
    """The sources that YAML documents (text) list, in the order of each list; lists that a source lacks are empty."""
    fields = [f.split(" ")[0] for f in SOURCE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            listed = [s for text in frame["text"] for s in parse_yaml(text or "").get("sources") or []]
            yield pd.DataFrame([tuple(s.get(k, [] if k in ("feeds", "topics", "flags") else None) for k in fields) for s in listed], columns=fields)

    return documents.select("text").mapInPandas(run, SOURCE)


def usable(sources: DataFrame, ids: Sequence[str] | None = None, without_paywall: bool = True) -> DataFrame:
    """Sources with feeds, of the ids if any are given, and without a paywall flag unless it may be there."""
    out = sources.where(F.size(F.coalesce("feeds", F.array().cast("array<string>"))) > 0)
    if without_paywall:
        out = out.where(~F.coalesce(F.array_contains("flags", "paywall"), F.lit(False)))
    return out.where(F.col("id").isin(list(ids))) if ids else out


def first_success(attempts: DataFrame, order: str = "attempt") -> tuple[DataFrame, DataFrame]:
    """Of fetch attempts in order: the first that succeeded for each source, and every failed one."""
    ok = attempts.where("success").groupBy("source_id").agg(F.min_by(F.struct(*attempts.columns), order).alias("r")).select("r.*")
    return ok, attempts.where(~F.col("success"))


def fresh(cache: DataFrame, now, minutes: int = 15) -> DataFrame:
    """Cache rows that aren't older than their time to live."""
    return cache.where(F.col("fetched_at") + F.expr(f"INTERVAL {int(minutes)} MINUTES") > F.lit(now))


def expired(cache: DataFrame, now, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Clears a cache: the rows that stay, and those that are older than so many hours and go."""
    old = F.coalesce(F.col("fetched_at") < F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False))
    return cache.where(~old), cache.where(old)


def with_source(items: DataFrame, sources: DataFrame, default_weight: int = 5) -> DataFrame:
    """Items with their source's name and weight, by default its id and ``default_weight``; Spark sends the small side everywhere."""
    known = sources.select(F.col("id").alias("source_id"), F.col("name").alias("__name"), F.col("weight").alias("__weight"))
    return items.join(known, "source_id", "left").withColumns({"source_name": F.coalesce("__name", "source_id"), "weight": F.coalesce("__weight", F.lit(default_weight))}).drop("__name", "__weight")
