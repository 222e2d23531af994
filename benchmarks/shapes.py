"""Times the public analyses on sparse, dense and mixed frames of a given number of rows and columns.

python benchmarks/shapes.py [sparse|dense|mixed] [rows] [columns] [analysis ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import stratalens as st  # noqa: E402


def frame(spark, kind: str, rows: int, columns: int):
    """sparse: 8 values, 70 % missing. dense: 4 to 40 strings, nothing missing. mixed: both, and numbers that are nearly unique."""
    at = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    made = []
    for i in range(columns):
        shape = kind if kind != "mixed" else ("sparse", "dense", "unique")[i % 3]
        if shape == "sparse":
            value = F.when(at(-i - 1, 10) >= 7, at(i, 8).cast("double"))
        elif shape == "dense":
            value = F.concat(F.lit("v"), at(i, 4 * (1 + i % 10)).cast("string"))
        else:
            value = at(i, 10 * rows).cast("double")
        made.append(value.alias(f"c{i}"))
    return spark.range(rows, numPartitions=8).select("id", *made)


ANALYSES = {
    "missingness": lambda df, names: st.missingness(df, features=names, position="id"),
    "levels": lambda df, names: st.levels(df, names, position="id"),
    "census": lambda df, names: st.census(df, names[:4], max_nodes=40, position="id"),
    "pairs": lambda df, names: st.pairs(df, names[:4], position="id"),
    "grain": lambda df, names: st.grain(df, names[:2], features=names, position="id"),
    "paths": lambda df, names: st.suggest_paths(df, features=names, position="id"),
    "patterns": lambda df, names: st.value_patterns(df, features=names, limits={"max_pairs": 20}, position="id"),
    "dependencies": lambda df, names: st.discover_dependencies(df, features=names, max_key_size=1, limits={"max_candidates": 20}, position="id"),
    "explore": lambda df, names: st.explore(df, position="id"),
}


def main() -> None:
    kind, rows, columns, *asked = [*sys.argv[1:], *["sparse", "10000", "150"][len(sys.argv) - 1 :]] if len(sys.argv) < 4 else sys.argv[1:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"file:///tmp/shapes-{os.getpid()}"
    frame(spark, kind, int(rows), int(columns)).write.parquet(folder)
    df = spark.read.parquet(folder)
    took = {}
    for name in asked or [n for n in ANALYSES if n != "explore"]:
        began = time.perf_counter()
        ANALYSES[name](df, [c for c in df.columns if c != "id"])
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"frame": kind, "rows": int(rows), "columns": int(columns), "seconds": took}))


if __name__ == "__main__":
    main()
