"""Structured Streaming: live segmentation, gap-free progress, checkpointed upserts."""
