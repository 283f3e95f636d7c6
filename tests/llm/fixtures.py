"""Small tables with every odd row the operators define a result for."""

import random

from pyspark.sql import types as T

#: Columns whose names the operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("spans", T.IntegerType()),
        T.StructField("shards", T.IntegerType()),
        T.StructField("block", T.StringType()),
        T.StructField("row", T.StringType()),
    ]
)
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or".split()


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    plain = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 120))) for _ in range(n)]
    # near copies, exact copies, a long text, a word without end
    plain += [p + " end" for p in plain[:15]] + plain[:10] + [plain[3]] * 5
    plain += [" ".join(rnd.choices(WORDS, k=6000)), "x" * 3000, "é日本 ß 𐍈\n\n a  b\t\x0b c"]
    return plain + ["", " \n", None, None, "a", "one two three four five", "1 2 3", "!!"]


def documents(spark, seed: int = 7):
    """Odd texts; two null ids, repeated rows, null sources and languages, clashing columns."""
    rnd, rows = random.Random(seed), []
    for i, text in enumerate(texts(seed)):
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["b", "a", "é", None]), None, "s", 1, 2, "b", "r"))
    rows += [rows[5], rows[5], (None, "the of and", "en", "a", 1, None, None, None, None, None), (None, None) + (None,) * 8]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
