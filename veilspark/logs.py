"""Logs of a driver: to the console and to a file that is turned over at a size."""

from __future__ import annotations

import logging
import logging.handlers
import os

LINE = "%(asctime)s | %(levelname)s | %(name)s | %(message)s"


def configured(folder: str | None = None, level: str = "INFO", most_bytes: int = 5_000_000, kept: int = 3) -> logging.Logger:
    """The package's logger; called again it changes the level and the file, without writing lines twice."""
    log = logging.getLogger("veilspark")
    log.setLevel(level.upper())
    log.propagate = False
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(os.path.join(folder, "veilspark.log"), maxBytes=most_bytes, backupCount=kept, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter(LINE))
        log.addHandler(h)
    return log
