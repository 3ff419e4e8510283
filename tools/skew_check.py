"""Measure task balance when one key holds a third of all rows.

Usage: python tools/skew_check.py [sf_dir]   (default /root/testdata/sf0.1)
Builds hot-key inputs from ``lineitem`` (every third row gets the same case,
sample or class), runs operators with Spark's event log written to a fresh
scratch folder, and writes SKEW.md: for every shuffle-reading stage, the
largest and the median number of shuffle records read by one task.  A
balanced plan keeps max/median small even though one key has 33 % of rows.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def read_log(log_dir: str) -> tuple[dict, dict]:
    """(stage id -> job description, stage id -> shuffle records read per task)."""
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f)]
    desc: dict = {}
    per_stage: dict = {}
    for path in sorted(files):
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    d = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        if d:
                            desc[sid] = d
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    per_stage.setdefault(ev["Stage ID"], []).append(rd)
    return desc, per_stage


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="tallyspark-eventlog-")
    from tallyspark.session import get_spark
    # 32 shuffle partitions, no coalescing: a hot partition would stand out.
    spark = get_spark("local[8]", 32, app="tallyspark-skew",
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                             "spark.eventLog.compress": "false",
                             "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    from tallyspark.operators import agree, ranking, sample, vehicle

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(8)
    hot = (F.col("l_orderkey") % 3 == 0)
    # vehicles: a third of all rows belong to case 0 (unique vehicle numbers inside it)
    veh = li.select(F.when(hot, F.lit(0)).otherwise(F.col("l_orderkey")).alias("caseid"),
                    F.when(hot, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int"))
                     .otherwise(F.col("l_linenumber")).alias("vehno"),
                    (F.col("l_partkey") % 6 + 1).cast("int").alias("crashcat"),
                    F.lit("A").alias("crashconf"), (F.col("l_suppkey") % 7).cast("int").alias("crashtype"))
    truth = veh.dropDuplicates(["caseid", "vehno"])
    pred = truth.withColumn("crashtype", (F.col("crashtype") + (F.col("vehno") % 3 == 0).cast("int")) % 7)
    # votes: a third of all rows are votes on sample 0
    votes = li.select(F.when(hot, F.lit(0)).otherwise(F.col("l_orderkey")).alias("sid"),
                      F.concat(F.lit("r"), F.col("l_linenumber").cast("string"), F.lit("_"),
                               F.col("l_partkey").cast("string")).alias("rater"),
                      (F.col("l_suppkey") % 7).cast("int").alias("pred"))
    # classes: a third of all rows in class 0
    cls = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("k"),
                    F.when(hot, F.lit(0)).otherwise(F.col("l_partkey") % 50 + 1).alias("c"))

    jobs = {
        "V3 vehicle_eval (hot case)": lambda: vehicle.vehicle_eval(truth, pred, "type"),
        "A5 sample_consistency (hot sample)": lambda: agree.sample_consistency(votes, ["sid"], "pred"),
        "N4 stratified_split (hot class)": lambda: sample.stratified_split(cls, ["k"], "c", 10, 1),
        "row_number_within (hot case)": lambda: ranking.row_number_within(
            truth.select("caseid", "vehno"), ["caseid"], ["vehno"], "pos"),
        "baseline: plain window over a hot case": lambda: truth.select(
            "caseid", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window
                                          .partitionBy("caseid").orderBy("vehno")).alias("pos")),
    }
    for name, make in jobs.items():
        spark.sparkContext.setJobDescription(name)
        make().write.format("noop").mode("overwrite").save()
    spark.stop()
    desc, stats = read_log(log_dir)
    out = ["# SKEW", "",
           f"One key holds a third of all rows (`tools/skew_check.py`, {os.path.basename(sf_dir)} lineitem, "
           "local[8], 32 shuffle partitions, AQE on without partition coalescing; event log in a scratch folder). For every stage that "
           "reads a shuffle: tasks, the most and the median shuffle records one task read.", "",
           "| job | stage | tasks | max records/task | median | max/median |", "|---|---|---|---|---|---|"]
    for name in jobs:
        for sid in sorted(s for s, d in desc.items() if d == name and s in stats):
            recs = stats[sid]
            if max(recs) == 0:
                continue
            med = statistics.median(recs)
            ratio = f"{max(recs) / med:.1f}" if med else "inf"
            out.append(f"| {name} | {sid} | {len(recs)} | {max(recs)} | {med:g} | {ratio} |")
    out += ["", "Reading the table:", "",
            "* The first stage of each job is the scan spread (8 equal tasks).",
            "* `baseline: plain window` is `row_number() over (partition by case)`: the hot case lands on one "
            "task — the imbalance the operators avoid.",
            "* V3 and A5 aggregate on (case, vehicle) / (sample, label) first and combine map-side, so the "
            "per-case / per-sample shuffles stay balanced.",
            "* `row_number_within` numbers rows per (range partition, case); the remaining spread comes from "
            "hashing whole (partition, case) groups, each at most one range partition, never the whole case.",
            "* In N4 the uneven stage is the per-class running count over hash-bucket counts: at most 2^18 rows "
            "per class whatever the data size; the rows themselves move by (class, bucket)."]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SKEW.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
