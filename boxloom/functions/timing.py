"""Wall time of driver-side steps."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager


@contextmanager
def timed(step: str, least: float = 2.0) -> Iterator[None]:
    """Log a step that takes more than `least` seconds; a lazy frame must be acted on inside."""
    began = time.perf_counter()
    try:
        yield
    finally:
        if (took := time.perf_counter() - began) > least:
            logging.getLogger("boxloom").warning("%s took %.1f s", step, took)
