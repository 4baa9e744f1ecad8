"""Documents with every oddity the operators have a rule for, and plain versions of the rules."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# columns named like the operators' own results and helpers
CLASHING = ["print", "key", "shard", "n_words", "tokens", "k1", "rate", "label0", "piece", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in CLASHING)

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sentence(rng: random.Random, words: int, vocabulary: int = 40, stem: str = "wort") -> str:
    return " ".join(f"{stem}{rng.randrange(vocabulary)}" for _ in range(words))


def odd_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    shared = sentence(rng, 60, 4000)
    rows: list[tuple[int | None, str | None]] = [(k, sentence(rng, rng.randrange(1, 90), 500)) for k in range(40)]
    rows += [(50 + k, f"{sentence(rng, 9, 500)} {shared} {sentence(rng, 8, 500)}") for k in range(6)]
    rows += [(60, None), (61, ""), (62, " \t\n "), (63, "één"), (64, "!!! ??? ...")]
    rows += [(65, rows[3][1]), (66, rows[3][1]), (67, rows[3][1]), (3, rows[3][1])]  # copies, and a repeated row
    rows += [(None, rows[5][1]), (None, None), (7, "same id, other text")]
    rows += [(70, "la " * 5000 + shared), (71, sentence(rng, 20000, 3000)), (72, "x" * 60000)]
    rows += [(73, shared.upper()), (74, shared.replace(" ", "\n"))]
    return rows


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    rows = odd_texts() if rows is None else rows
    full = [(k, text, "en" if k is None or k % 2 else None, None if k == 4 else "s", None if text is None else len(text), *["other"] * len(CLASHING)) for k, text in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
