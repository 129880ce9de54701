"""Small document tables with the cases that every operator must take, and plain counterparts."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\t-\r]+")
VOCABULARY = [a + b + c for a in ("ba", "lo", "mi", "tre", "sha") for b in ("n", "rd", "st", "k") for c in ("er", "ing", "a", "on", "ly")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def odd_rows() -> list[tuple]:
    """Null and empty fields, long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    some = prose(rng, 80)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, "b", 3), (4, some, "en", None, 9), (5, some, "en", "a", 9), (6, long, "en", "b", len(long)),
        (7, "x", "en", "b", 1), (None, prose(rng, 60), "en", "c", 5), (8, "é😀 " * 50, "fr", "c", 150), (9, some, "en", "a", 9), (9, some, "en", "a", 9), (10, "\u0001\u0002 a b c d e f", "en", "é", 2),
    ]


def documents(spark, rows):
    """The rows with columns that operators use inside, to show that these do not clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", F.lit(1).alias("size"), F.lit("z").alias("bucket"), F.lit(2.5).alias("_h"), F.lit(0).alias("shard"), F.lit("k").alias("digest"), F.lit(3).alias("_row"), F.lit(1).alias("x"))


def corpus(spark, n=300, seed=1):
    """Plain documents of several sources, one of which has a third of the rows, with copies and near copies."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.2:
            text = rng.choice(texts)
            if rng.random() < 0.6:
                words = text.split(" ")
                words[rng.randrange(len(words))] = "changed"
                text = " ".join(words)
        else:
            text = prose(rng, rng.choice([3, 40, 120, 300]))
        texts.append(text)
        rows.append((i, text, "en", "hot" if rng.random() < 0.35 else f"s{rng.randrange(6)}", len(text)))
    return spark.createDataFrame(rows, DOCS), rows


def words(text):
    return WORD.findall(text or "")
