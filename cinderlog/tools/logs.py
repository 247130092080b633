"""Logging of the driver: errors to stderr, all else to stdout, everything to a file if one is named."""

from __future__ import annotations

import logging
import sys

SHAPE = "[%(asctime)s] %(levelname)s %(name)s: %(message)s"
_MAGENTA, _PLAIN = "\x1b[95m", "\x1b[0m"


class _Coloured(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        head, colon, text = super().format(record).partition(": ")
        return f"{_MAGENTA}{head}{_PLAIN}{colon}{text}"


def set_up(level: int = logging.INFO, file: str | None = None, colour: bool | None = None) -> None:
    """Replace the root logger's handlers. colour: by default where stdout is a terminal."""
    root = logging.getLogger()
    for old in list(root.handlers):
        root.removeHandler(old)
        old.close()
    shape = _Coloured(SHAPE) if (sys.stdout.isatty() if colour is None else colour) else logging.Formatter(SHAPE)
    out, err = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    out.addFilter(lambda record: record.levelno < logging.ERROR)
    err.setLevel(logging.ERROR)
    for handler in (out, err):
        handler.setFormatter(shape)
        root.addHandler(handler)
    if file:
        kept = logging.FileHandler(file, encoding="utf-8")
        kept.setFormatter(logging.Formatter(SHAPE))
        root.addHandler(kept)
    root.setLevel(level)
