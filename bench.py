"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each is the least of some warm runs, but for index_build_cold, the session's first job, and segment_merge, which runs
once. The session has 8 shuffle partitions and 12 GB of memory, else Spark's defaults.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.operators import index
from quillspark.plans.retrieve import retrieve, retrieve_exact
from quillspark.queries import retrieval, stores
from quillspark.storage import new_path

HERE = os.path.dirname(os.path.abspath(__file__))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(run, times: int = 3) -> float:
    """The least of some runs, in seconds."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(min(took), 3)


def main() -> None:
    sys.path.insert(0, HERE)
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}

    def build() -> None:
        docs = retrieval.documents(spark, SF_DIR).withColumn("_segment", F.lit("s0"))
        index.write_index(docs, new_path(spark, "bench"), "_segment")

    found["index_build_cold"] = timed(build, 1)
    found["index_build"] = timed(build, 2)
    held = retrieval.built(spark, SF_DIR)
    run = lambda df: df.collect()
    for term in ("THE", "AND", "ORANTION", "WORTHLESS"):
        found[f"exact_{term.lower()}"] = timed(lambda term=term: run(retrieve_exact(held, term).orderBy(F.col("score").desc(), "doc_id").limit(20)))
        found[f"retrieve_{term.lower()}"] = timed(lambda term=term: run(retrieve(held, [term]).best()))
    for mode in ("and", "or"):
        found[f"search_the_tion_{mode}"] = timed(lambda mode=mode: run(retrieve(held, ["THE", "TION"], mode).best()))
    found["retrieve_prefix_tion"] = timed(lambda: run(retrieve(held, ["TION"], window="prefix").best()))
    found["page_the_tion"] = timed(lambda: run(retrieve(held, ["THE", "TION"]).page(retrieval.documents(spark, SF_DIR))))
    found["phrase_the_tion"] = timed(lambda: run(retrieve(held, ["THE", "TION"]).by_phrase().orderBy(F.col("score").desc()).limit(20)))
    halves = new_path(spark, "halves")
    index.write_index(retrieval.documents(spark, SF_DIR).withColumn("_segment", F.concat(F.lit("s"), F.col("doc_id") % 2)), halves, "_segment")
    found["segment_merge"] = timed(lambda: index.compact(spark, halves, 1), 1)
    found["json_flatten"] = timed(lambda: stores.json_flatten(spark, SF_DIR).write.format("noop").mode("overwrite").save(), 2)
    found["version_chain"] = timed(lambda: stores.version_chain(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    found["wal_replay"] = timed(lambda: stores.wal_replay(spark, SF_DIR).write.format("noop").mode("overwrite").save(), 2)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
