"""Row numbers within groups that stay parallel when one group is huge.

``row_number() over (partition by g order by o)`` puts each group into one
task.  Here rows are range-partitioned on (g, o) instead, so a group holding
a third of the table spans many partitions; rows are numbered per
(partition, group), and each (partition, group) gets the count of the same
group's rows in earlier partitions as an offset.  The offset table has one
row per (partition, group): a hot group adds one row per partition.

The range-partitioned rows are checkpointed once (reliable checkpoint in
``spark.checkpoint.dir``): partition ids come from one materialisation,
and a lost executor cannot re-draw the range bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions.joins import join_keys
from tallyspark.session import ensure_checkpoint_dir


def row_number_within(df: DataFrame, group: list[str], order: list[str], out: str = "rn",
                      partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Exact 1-based row number (BIGINT) per ``group`` in ``order`` (a total
    order within the group, as for ``row_number``); with ``total`` also the
    group's row count in that column.

    Only groups that cross a partition edge have an offset: at most two per
    partition, whatever the number of groups, so that table is broadcast.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The partition id is only meaningful for one materialisation of the
    # range partitioning: checkpoint it (shared checkpoint folder) so that
    # the numbering and the offsets read the very same assignment.
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in group + order])
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    here = Window.partitionBy("_pid", *group)
    local = ranged.withColumn("_lrn", F.row_number().over(here.orderBy(*order)).cast("long"))
    if total:
        local = local.withColumn("_lc", F.count(F.lit(1)).over(here))
    counts = ranged.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"))
    edges = Window.partitionBy(*group)
    before = edges.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_off", F.sum("_cnt").over(before)).withColumn("_all", F.sum("_cnt").over(edges))
               .where("_all > _cnt").select("_pid", *group, F.coalesce("_off", F.lit(0)).alias("_off"), "_all"))
    j = join_keys(local, F.broadcast(offsets), ["_pid", *group], "left")
    cols = [*df.columns, (F.col("_lrn") + F.coalesce("_off", F.lit(0))).alias(out)]
    if total:
        cols.append(F.coalesce("_all", "_lc").alias(total))
    return j.select(*cols)
