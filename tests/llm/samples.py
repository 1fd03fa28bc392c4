"""Rows that the tests of the corpus operators share."""

from random import Random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"

WORDS = "the and of river stone light green field water story morning path letter house garden window silver quiet road mountain".split()


def sentence(k, n=30):
    return " ".join(Random(k).choices(WORDS, k=n))


def folder_of(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
