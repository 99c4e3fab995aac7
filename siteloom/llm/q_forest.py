"""op2: nearest neighbours of embeddings."""

from . import forest
from .registry import query, table


@query("op2_prefix_forest_neighbours")
def op2(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(rows, rows.where("vec_id % 20 = 0"))
