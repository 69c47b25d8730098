"""Snapshot freshness (T1, T2) and incremental refresh of landed files."""

from rankmart.streaming.snapshot import latest_snapshot, last_refresh  # noqa: F401
from rankmart.streaming.refresh import start_refresh, stream_refresh_status  # noqa: F401
