import random

from skein.llm.common import connected_components

rng = random.Random(4)


def test_rounds_of_few_edges_are_a_task_each(spark):
    """However many the shuffle partitions; results by union-find."""
    edges = [(a, rng.randrange(a)) for a in range(1, 400) if a % 7] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("components", "")
    try:
        got = {r.node: r.component for r in connected_components(df).collect()}
        track = context.statusTracker()
        stages = {s for j in track.getJobIdsForGroup("components") for s in track.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {x: top(x) for x in parent}
    assert tasks < 500, tasks
