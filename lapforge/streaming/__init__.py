"""Row-wise operators over streams of samples, and the ingest of growing folders."""

from .ingest import follow, write_bounded

__all__ = ["follow", "write_bounded"]
