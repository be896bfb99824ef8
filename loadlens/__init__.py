"""loadlens: workload and benchmark analytics as plain Spark jobs."""

from loadlens.session import build_session, scratch_path, snapshot

__all__ = ["build_session", "scratch_path", "snapshot"]
