"""op5: documents that hold benchmark items."""

from . import tiling
from .registry import query, table


@query("op5_benchmark_decontamination")
def op5(spark, sf_dir):
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
