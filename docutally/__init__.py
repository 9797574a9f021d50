"""docutally: document extraction, request-log analytics and extraction scoring on Spark."""

from docutally.session import configure, fresh_path, shared_dir

__all__ = ["configure", "fresh_path", "shared_dir"]
