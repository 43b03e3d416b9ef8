"""Structured Streaming.  The workload has no streams; the keyed folds of ``tessera.operators.folds``
also run inside ``foreachBatch``, for which ``incremental`` keeps a last-write-wins table."""
