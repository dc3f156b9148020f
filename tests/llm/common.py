"""Small tables with what real ones hold: nulls, empty and very long texts, repeated rows, clashing columns."""

import random

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside, as extra columns of the input.
CLASHING = ["g", "x", "n", "f", "key", "a", "b", "u", "v", "m", "doc", "node", "root", "own", "centre", "inverse", "start", "distance", "log_weight", "kept", "block", "half", "label", "quality", "toxic", "score", "spans", "cleaned", "ids", "n_tokens", "n_words", "bucket", "raw", "target", "__id", "__label", "__weight", "__x", "__own", "__gone", "__twice", "__text", "__toxic", "lead", "pos", "col"]


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def edge_documents(spark, clashing: bool = True):
    rng = random.Random(1)
    rows = [(i, words(rng, 60), "en", "web", 0) for i in range(80)]
    rows += [(100, None, "en", "web", None), (101, "", None, None, 0), (102, " \n\t ", "en", None, 0), (103, "!!! ???", None, "web", 7), (None, "no id here at all", "en", "web", 1), (None, None, None, None, None)]
    rows += [(104, words(rng, 60_000, 3000), "de", "book", 0), (105, "x" * 300_000, "de", "book", 0), (106, "é ü 漢字 \U0001f600 ▁ \x00 end", "fr", "web", 0)]
    rows += [(3, rows[3][1], "en", "web", 0), (3, rows[3][1], "en", "web", 0), (107, rows[4][1], "en", "web", 0), (108, rows[4][1], "en", "other", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
    return df.repartition(3)


def edge_labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (70, None, 1), (71, 1, None), (1, 0, 0), (1, 1, 1), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")
