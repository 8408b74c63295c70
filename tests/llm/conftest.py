import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(n, seed, pool="the of and water lake river stone bridge under license mit apache blue green mountain nine seven x1 ärger straße él niño".split()):
    r = random.Random(seed)
    return " ".join(r.choice(pool) + str(r.randrange(60)) for _ in range(n))


def rows():
    out = [(k, words(30 + k % 50, k), ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], 1) for k in range(60)]
    base = words(200, 999)
    w = base.split()
    out += [(100 + k, base, "en", "a", 1) for k in range(8)]  # copies
    for k in range(6):  # near copies
        v = list(w)
        v[20 + 25 * k] = f"changed{k}"
        out.append((200 + k, " ".join(v), "en", "a", 1))
    out += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n", "en", "b", 3), (303, "one two", "en", "b", 7), (304, "one two", "en", "b", 7), (305, "x" * 200_000, "en", "a", 1), (None, "no id here at all", "en", "a", 1)]
    out += [(306, "Under the MIT license, see apache-license (version 2.0) and CC BY-NC 4.0!", "en", "a", 1), (306, "Under the MIT license, see apache-license (version 2.0) and CC BY-NC 4.0!", "en", "a", 1)]
    out += [(307, "mail jo.doe@mail.example.com or +49 (30) 123-45678, card 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256 a@b", "en", "b", 1)]
    out += [(308, words(20_000, 5), "en", "a", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of all sorts, with an extra column whose name results use too."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows(), DOCUMENTS).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(7)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
