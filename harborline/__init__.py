"""Account-health analytics as Spark jobs."""

from harborline.config import Config

__all__ = ["Config"]
