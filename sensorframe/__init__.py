"""PySpark operators for labelled sensor and frame streams."""

from sensorframe.session import configure, local_session

__all__ = ["configure", "local_session"]
