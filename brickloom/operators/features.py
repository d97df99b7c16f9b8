"""Feature vectors, vocabulary filters and vehicle filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.functions.geometry import cell
from brickloom.lookups import (
    ALLOWED_COLORS, ALLOWED_PARTS, VEHICLE_KEYWORDS, VEHICLE_PARTS, VEHICLE_TYRES,
)


def node_features(part: Column, color: Column, vocab: list[str] = ALLOWED_PARTS,
                  colors: list[int] = ALLOWED_COLORS, fallback: bool = False) -> Column:
    """One-hot part, one-hot colour, position, rotation. Unknown values are all zeros, or with
    ``fallback`` set the first slot."""

    def one_hot(value: Column, known: list) -> Column:
        hits = [(value == F.lit(v)).cast("double") for v in known]
        if fallback:
            missing = ~value.isin(known)
            hits[0] = F.when(missing, 1.0).otherwise(hits[0])
        return F.array(*hits)

    pose = [cell("transform", i, 3) for i in range(3)] + [cell("transform", i, j) for i in range(3) for j in range(3)]
    return F.concat(one_hot(part, vocab), one_hot(color, colors), F.array(*pose))


def vocab_valid(parts: DataFrame, vocab: list[str] = ALLOWED_PARTS, colors: list[int] = ALLOWED_COLORS) -> DataFrame:
    """True when all parts and colours of an assembly are in the vocabulary."""
    good = F.col("part_id").isin(vocab) & F.col("color").isin(colors)
    return parts.groupBy("assembly_id").agg(F.bool_and(good).alias("valid"))


def is_vehicle(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Four tyres, or a keyword in the file name with two tyres or four vehicle parts.

    names: assembly_id, file_name. Only the tyre ids count as wheels here.
    """
    pid = F.lower("part_id")
    counts = parts.groupBy("assembly_id").agg(
        F.count_if(pid.isin(VEHICLE_TYRES)).alias("wheels"), F.count_if(pid.isin(VEHICLE_PARTS)).alias("kit")
    )
    pattern = "|".join(VEHICLE_KEYWORDS)
    keyword = F.lower("file_name").rlike(pattern)
    return counts.join(names, "assembly_id").select(
        "assembly_id",
        ((F.col("wheels") >= 4) | (keyword & ((F.col("wheels") >= 2) | (F.col("kit") >= 4)))).alias("is_vehicle"),
    )


def skip_synthetic(df: DataFrame, name: str = "assembly_id") -> DataFrame:
    return df.filter(~F.col(name).contains("Synthetic") & ~F.col(name).startswith("9999-"))


def prefer_synthetic(df: DataFrame, name: str = "assembly_id") -> DataFrame:
    """Only the synthetic assemblies when there are any, else all."""
    synthetic = df.filter(F.col(name).startswith("9999"))
    return df if synthetic.isEmpty() else synthetic


# Words that route a set to a theme subset.
CITY_WORDS = """
city town racer truck buggy car police fire formula1 kart roadster jeep auto tractor
""".split()
STAR_WORDS = "star wars fighter space rover ship grey gray 31066".split()


def theme_subsets(df: DataFrame, name: str) -> DataFrame:
    """Route to the city subset, else the star subset; without any word to both."""
    low = F.lower(name)
    subset = (
        F.when(low.rlike("|".join(CITY_WORDS)), F.array(F.lit("city")))
        .when(low.rlike("|".join(STAR_WORDS)), F.array(F.lit("star_wars")))
        .otherwise(F.array(F.lit("city"), F.lit("star_wars")))
    )
    return df.withColumn("subset", F.explode(subset))
