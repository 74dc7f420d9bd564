"""Logging and timing, with the switches DISABLE_LOG, ENABLE_PRINT_LOG and ENABLE_TIME_LOG. [A22]"""

from __future__ import annotations

import contextlib
import logging
import os
import time

_logger = logging.getLogger("fragloom")


def _on(name: str, default: bool = False) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def configure(path: str | None = None) -> None:
    _logger.handlers.clear()
    _logger.setLevel(logging.INFO)
    if _on("DISABLE_LOG"):
        _logger.addHandler(logging.NullHandler())
        return
    if path:
        _logger.addHandler(logging.FileHandler(path))
    if _on("ENABLE_PRINT_LOG") or not path:
        _logger.addHandler(logging.StreamHandler())


def info(message: str, *args: object) -> None:
    _logger.info(message, *args)


def warn(message: str, *args: object) -> None:
    _logger.warning(message, *args)


def format_duration(seconds: float) -> str:
    minutes, rest = divmod(seconds, 60)
    return f"{int(minutes)}m {rest:.1f}s" if minutes else f"{rest:.2f}s"


@contextlib.contextmanager
def timed(what: str):
    began = time.monotonic()
    yield
    if _on("ENABLE_TIME_LOG"):
        info("%s: %s", what, format_duration(time.monotonic() - began))
