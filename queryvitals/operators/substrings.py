"""Names that contain some text anywhere, by an index of their character n-grams.

``postings`` has one row for each distinct gram of one, two and three characters of each name; sorted by gram, so that a
reader of a few grams opens a few row groups. A needle of three characters or more takes its rarest grams, of which a
name must have all, and what they leave is verified; a shorter needle is itself a gram, and its postings are the answer.
All needles are looked up at once. An empty needle is contained in nothing; repeated needles count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 3
#: Grams of a needle that are intersected before names are looked at.
RAREST = 3


def grams(text: Column, size: int) -> Column:
    """Distinct grams of a size."""
    last = F.length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def postings(names: DataFrame, keys: list[str], text: str = "norm_name") -> DataFrame:
    """(gram, *keys) of names; ``keys`` tell them apart."""
    every = F.concat(*[grams(F.col(text), n) for n in range(1, LONGEST + 1)])
    return names.where(F.col(text).isNotNull()).select(F.explode(every).alias("gram"), *keys).distinct()


def ordered(found: DataFrame) -> DataFrame:
    """The postings as they are written: ranges of grams, in order."""
    return found.repartitionByRange("gram").sortWithinPartitions("gram")


def containing(needles: DataFrame, index: DataFrame, names: DataFrame, keys: list[str], needle: str = "needle", text: str = "norm_name") -> DataFrame:
    """(needle, *keys) of the names that contain each needle."""
    asked = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    size = F.least(F.length("needle"), F.lit(LONGEST))
    wanted = asked.select("needle", F.explode(F.when(size == 1, grams(F.col("needle"), 1)).when(size == 2, grams(F.col("needle"), 2)).otherwise(grams(F.col("needle"), LONGEST))).alias("gram"))
    counted = index.join(wanted.select("gram").distinct(), "gram", "left_semi")
    weight = counted.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no name has makes its needle one that no name contains.
    rank = F.row_number().over(Window.partitionBy("needle").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    rarest = wanted.join(weight, "gram", "left").withColumn("rank", rank).where(F.col("rank") <= RAREST)
    many = rarest.groupBy("needle").agg(F.count("*").alias("many"))
    met = counted.join(rarest.select("needle", "gram"), "gram").groupBy("needle", *keys).agg(F.count("*").alias("had"))
    left = met.join(many, "needle").where("had = many").select("needle", *keys)
    return left.join(names.select(*keys, F.col(text).alias("_text")), keys).where(F.contains("_text", "needle")).select("needle", *keys)


def lookup(needles: list[str], index: DataFrame, names: DataFrame, keys: list[str], text: str = "norm_name") -> DataFrame:
    """``containing`` for a few needles that the driver knows: only their grams are read from a stored index."""
    wanted = {n[i : i + size] for n in needles for size in [min(len(n), LONGEST)] for i in range(len(n) - size + 1)}
    few = index.where(F.col("gram").isin(sorted(wanted - {""})))
    return containing(index.sparkSession.createDataFrame([(n,) for n in needles], "needle string"), few, names, keys, text=text)


def word_sequences(text: str) -> list[str]:
    """All runs of whole words of a folded text, the longest first."""
    words = text.split(" ")
    every = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    return sorted(every, key=lambda x: (-len(x), x))
