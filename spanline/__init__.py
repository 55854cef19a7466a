"""Timeline, segment and transcript analytics as plain Spark DataFrame functions."""
