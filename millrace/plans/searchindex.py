"""An inverted index of the catalog's texts, and many questions to it at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .catalog import LOW_INFORMATION, WEIGHTS, query_tokens, search_fields

#: Letters of a gram: words of a question have two at least, so that each has a gram.
GRAM = 2
#: Words up to which they are sent to every executor.
FEW = 100_000


def field_texts(catalog: DataFrame) -> DataFrame:
    """layer, name, field and text (in lower case) of what can be found in each entry; empty texts are left out."""
    rows = catalog.select("layer", F.col("name").alias("entry"), F.explode(F.create_map(*(x for f, t in search_fields().items() for x in (F.lit(f), t)))).alias("field", "text"))
    return rows.where("text <> ''").withColumnRenamed("entry", "name")


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda p: F.substring(text, p, F.lit(GRAM))))


def postings(texts: DataFrame) -> DataFrame:
    """gram, layer, name, field and text: a row for each distinct pair of letters of a text.  Store it sorted by gram to search it often."""
    return texts.select(F.explode(_grams(F.col("text"))).alias("gram"), "layer", "name", "field", "text").where(F.length("gram") == GRAM)


def question_words(questions: DataFrame, id_: str = "question_id", question: str = "question") -> DataFrame:
    """question_id and word: the words that a question is asked by, see query_tokens()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, word) for i, q in zip(frame["id"], frame["q"], strict=True) for word in query_tokens(q or "")]
            yield pd.DataFrame(rows, columns=["id", "word"])

    kind = questions.schema[id_].dataType.simpleString()
    return questions.select(F.col(id_).alias("id"), F.col(question).alias("q")).mapInPandas(run, f"id {kind}, word string").withColumnRenamed("id", id_)


def search_many(index: DataFrame, entries: DataFrame, questions: DataFrame, n: int = 20, prefer: Sequence[str] = ("ADS", "DWS", "DWT"), id_: str = "question_id", question: str = "question") -> DataFrame:
    """question_id, layer, name, score and place of the n best entries for each question; scores are those of catalog.search().

    Words are looked up in the index by the rarest of their grams, so that a
    word is held only against texts that may contain it, and once however
    many questions have it.  Entries of preferred layers count without any
    hit; of these only the first n of each layer can be among the best, and
    only they are considered.
    """
    words = question_words(questions, id_, question)
    distinct = words.select("word").distinct()
    counts = index.groupBy("gram").agg(F.count("*").alias("texts"))
    asked = distinct.select("word", F.explode(_grams(F.col("word"))).alias("gram")).join(counts, "gram", "left")
    # a word with a gram that no text has is in no text
    rarest = asked.groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    shared_folder(index.sparkSession)
    rarest = rarest.checkpoint()
    if rarest.count() <= FEW:  # then the index isn't shuffled
        rarest = F.broadcast(rarest)
    found = index.join(rarest, "gram").where(F.contains("text", F.col("word")))
    weight = F.create_map(*(x for f, w in WEIGHTS.items() for x in (F.lit(f), F.lit(w))))[F.col("field")]
    half = F.when(F.col("word").isin(*LOW_INFORMATION), 0.5).otherwise(1.0)
    hits = found.groupBy("word", "layer", "name").agg(F.sum(weight * half).alias("hits"))
    scored = words.join(hits, "word").groupBy(id_, "layer", "name").agg(F.sum("hits").alias("hits"))
    bonus = F.lit(0.0)
    for k, layer in enumerate(prefer):
        bonus = F.when(F.col("layer") == layer, float(max(0, 3 - k))).otherwise(bonus)
    first = entries.where(bonus > 0).select("layer", "name").distinct().withColumn("at", F.row_number().over(Window.partitionBy("layer").orderBy("name"))).where(F.col("at") <= n).drop("at")
    # n rows of each preferred layer for every question
    free = questions.select(F.col(id_)).distinct().crossJoin(F.broadcast(first)).withColumn("hits", F.lit(0.0))
    both = scored.unionByName(free).groupBy(id_, "layer", "name").agg(F.max("hits").alias("hits")).withColumn("score", F.col("hits") + bonus)
    place = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("score"), "layer", "name"))
    return both.withColumn("place", place).where((F.col("place") <= n) & (F.col("score") > 0)).select(id_, "layer", "name", "score", "place")
