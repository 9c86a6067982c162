"""Streaming entry points. The reference is batch-only (no watermarks, windows or
state); the only stream here is request serving, which reuses the batch operators."""

from tastebud.streaming.requests import serve_requests

__all__ = ["serve_requests"]
