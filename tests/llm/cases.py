"""Small inputs with the awkward rows every corpus operator must stand."""

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = ["the", "of", "and", "tion", "ing", "Haanth", "onever", "ciónra", "schü", "réeux", "über", "naïve", "x1y2", "42", "don't", "a-b", "end."]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (rnd.choice(WORDS) if rnd.random() < 0.7 else "") for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): null and empty texts, copies, repeated rows, long and odd texts."""
    long = prose(1, 30_000)
    same = prose(2, 120)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, same), (6, same), (6, same), (7, same + " more"),
            (8, long), (9, "x" * 5000), (10, "日本語の文章。" * 300), (11, "<|endoftext|> a<|startoftext|>b <|endoftext|>"),
            (12, "tab\tand\x1cfile\x1dsep nbsp em"), (13, "Σίσυφος ΟΔΟΣ İstanbul ﬁ"), (14, "é ́x Å"),
            (15, prose(3, 200) + " " + same + " " + prose(4, 50)), (None, "no id here"), (17, "a" * 99), (18, "a" * 250),
            (19, "the the the the " * 60), (20, "the the the the " * 60)]
    return rows + [(100 + i, prose(50 + i, 5 + 7 * i)) for i in range(20)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows as documents, dealt over partitions, with extra columns of names that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.selectExpr("doc_id", "text", "1 as n", "'x' as key", "2 as shard", "'y' as link", "0 as start", "'z' as _b", "3 as r")
