"""Incremental, checkpointed forms of the batch jobs."""
