"""op11: whitened embeddings."""

from pyspark.sql import functions as F

from . import whitening
from .registry import query, table


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained())).cast("array<double>")
    long = rows.select("id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("pos", "whitened"))
    return long.select(
        F.col("id").cast("long").alias("vec_id"), (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(explained, F.col("pos")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
