"""Rows that an action writes to shuffles."""


def rows_shuffled(spark, action) -> int:
    context = spark.sparkContext
    store, group = context._jsc.sc().statusStore(), "rows_shuffled"
    context.setJobGroup(group, group)
    try:
        action()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    finally:
        context._jsc.sc().clearJobGroup()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
