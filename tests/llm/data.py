"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROSE = "The harbour wakes early and the boats go out in the dark with their lamps. " "It is a quiet trade, and those who follow it know the weather well. "
OTHER = "A long road leads from the mill to the town, and on it the carts were slow that year. " "She said that he had not been there for the market. "
LONG = " ".join(f"word{i % 911}x{i % 7} the of and" for i in range(60_000))
EXTRA = ("row_key", "label", "part", "fp", "n", "k", "row", "kept", "t", "w", "order", "shard", "is_kept", "tokens", "bucket", "a.b", "group_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """rows of (doc_id, text[, source[, lang]])."""
    full = []
    for r in rows:
        doc_id, text, source, lang = (*r, *("src0", "en")[len(r) - 2 :])
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, SCHEMA)
    for i, name in enumerate(EXTRA if extra else ()):
        df = df.withColumn(name, F.lit(f"extra{i}"))
    return df


def hard(spark: SparkSession, extra: bool = True) -> DataFrame:
    return documents(
        spark,
        [
            (1, PROSE), (1, PROSE), (2, PROSE), (3, OTHER, None), (None, OTHER), (None, None, None, None), (4, None), (5, ""), (6, "  \n\t "), (7, "!!! ???"), (8, LONG), (9, OTHER, "src1", None),
            (10, 'config\npassword = "Zx81kQp0vTr5mLw"\n' + PROSE), (9, OTHER, "src1", None),
        ],
        extra,
    )


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])


def rows(df: DataFrame, *names: str) -> list[tuple]:
    """df's rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)
