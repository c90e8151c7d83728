"""millrace: lakehouse operators as plain ``DataFrame -> DataFrame`` functions on Spark."""

from millrace.session import build_session, shared_dir, stage

__all__ = ["build_session", "shared_dir", "stage"]
