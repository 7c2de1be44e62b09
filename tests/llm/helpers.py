from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def sample(sf="sf0.001"):
    import pyarrow.parquet as pq

    return pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pandas()


CLASHES = ["digest", "node", "key", "shard", "uid", "pm_digest", "PM_UID", "pm_rest", "kept", "start", "n", "pm_winner"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])
