from tracewright.operators.messages import TASK_ROWS, dealt


def test_tasks_that_sort_messages_follow_their_number(spark):
    """More messages are more tasks, not larger ones; few stay with the session's shuffle partitions, as do those whose number is not known."""
    messages, most = spark.range(7).withColumnRenamed("id", "trace_id"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(messages, (most + 3) * TASK_ROWS - 1, "trace_id").rdd.getNumPartitions() == most + 3
    assert dealt(messages, most * TASK_ROWS, "trace_id") is messages and dealt(messages, None, "trace_id") is messages
