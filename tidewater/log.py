"""Package logger: levels below ERROR to stdout, the rest to stderr, coloured by level."""

from __future__ import annotations

import logging
import sys

#: ANSI colour of each level; fixed values.
COLOURS = {"DEBUG": "\033[36m", "INFO": "\033[32m", "WARNING": "\033[33m", "ERROR": "\033[31m", "CRITICAL": "\033[35m"}


class ColouredFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"{COLOURS.get(record.levelname, '')}{super().format(record)}\033[0m"


def get_logger(name: str = "tidewater", level: int = logging.INFO) -> logging.Logger:
    """The named logger; handlers are attached once."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        low, high = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
        low.addFilter(lambda r: r.levelno < logging.ERROR)
        high.setLevel(logging.ERROR)
        for h in (low, high):
            h.setFormatter(ColouredFormatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            logger.addHandler(h)
        logger.setLevel(level)
    return logger


def set_level(level: int, name: str = "tidewater") -> None:
    get_logger(name).setLevel(level)
