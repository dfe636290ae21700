"""Where reports go."""

from plumbline.sinks.report import publish_report, published_report, save_report

__all__ = ["publish_report", "published_report", "save_report"]
