"""Logging of the package's own steps."""

from __future__ import annotations

import logging


def setup(level: int = logging.INFO) -> logging.Logger:
    """A handler for the package's logger, once; Spark's own log is left as it is."""
    log = logging.getLogger("plotweave")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log
