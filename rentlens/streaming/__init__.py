"""Structured Streaming: incremental ingest, windowed metrics, stream scoring.

All sinks are file sinks with a checkpoint under the shared checkpoint
folder, so a restarted query (lost executor, lost driver) resumes exactly
once from its last committed batch.
"""
