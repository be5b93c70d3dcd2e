"""Dictionary query expansion: append the phrases of every key found in a question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmere.session import at_most, small, written

GRAM = 4
END = 8  # characters of a key's ends by which most keys are told from all questions
DICTIONARY_SCHEMA = "key_pos long, key string, val_pos long, value string"


def dictionary_table(spark: SparkSession, entries: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key_pos, key, val_pos, value): a mapping as a table; positions carry its order."""
    rows = [
        (i, key, j, value)
        for i, (key, values) in enumerate(entries.items())
        for j, value in enumerate(values)
    ]
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)


def _rare_grams(keys: DataFrame) -> DataFrame:
    """(key, gram): of each key's GRAM-character substrings the one fewest keys hold; a
    shorter key is its own gram."""
    size = F.length("key")
    grams = F.when(size < GRAM, F.array("key")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1))), lambda at: F.substring("key", at, GRAM)))
    )
    held = keys.select("key", F.explode(grams).alias("gram"))
    counted = held.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
    return counted.groupBy("key").agg(F.min(F.struct("n", "gram")).alias("g")).select("key", "g.gram")


def _substrings(text: str, longest: int) -> Column:
    """array<string>: every different substring of up to `longest` characters, the empty one included."""
    size = F.length(text)
    at_n = F.transform(
        F.sequence(F.lit(0), F.lit(longest)),
        lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda at: F.substring(F.col(text), at, n)),
    )
    return F.array_distinct(F.flatten(at_n))


def matched_keys(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(qid, key): the keys that are substrings of the lower-cased question.

    Questions and keys meet on one rare gram of the key, so that a dictionary of any size is
    one equi-join of short rows; then the whole key is looked for. Keys whose first or last
    characters no question holds are dropped before anything is shuffled. A written table.
    """
    lowered = questions.select("qid", F.lower("question").alias("_q"))
    pieces = lowered.select("qid", "_q", F.explode_outer(_substrings("_q", GRAM)).alias("gram"))
    ends = written(lowered.select(F.explode_outer(_substrings("_q", END)).alias("_end")).distinct(), "question-ends")
    fits = at_most(ends)
    keys = dictionary.select("key")
    for end in (F.left("key", F.lit(END)), F.right("key", F.lit(END))):
        keys = keys.withColumn("_end", end).join(small(ends, fits), "_end", "left_semi").drop("_end")
    keys = _rare_grams(written(keys.distinct(), "near-keys"))
    return written(pieces.join(keys, "gram").filter(F.contains("_q", "key")).select("qid", "key"), "matched-keys")


def expand_questions(questions: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Add `expanded`: the question followed by the phrases of the keys it contains.

    A phrase is appended once, ignoring case, at its first position.
    """
    if dictionary is None:
        return questions.withColumn("expanded", F.col("question"))
    first = Window.partitionBy("qid", F.lower("value")).orderBy("key_pos", "val_pos")
    matched = matched_keys(questions, dictionary)
    phrases = (
        dictionary.join(small(matched, at_most(matched)), "key")
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("key_pos", "val_pos", "value"))).alias("_p"))
        .select("qid", F.array_join(F.transform("_p", lambda p: p["value"]), " ").alias("_extra"))
    )
    return (
        questions.join(phrases, "qid", "left")
        .withColumn("expanded", F.concat_ws(" ", "question", "_extra"))
        .drop("_extra")
    )
