"""Where the library's messages go: warnings to the console, all to rotating files, its own details to a third."""

from __future__ import annotations

import logging
import logging.handlers
import re
from pathlib import Path

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"
#: Bytes of a log file, and older ones that are kept.
SIZE, KEPT = 5 << 20, 3
#: Messages of other libraries that say nothing about a query.
NOISE = re.compile(r"py4j|incubator modules|NativeCodeLoader|SPARK_LOCAL_IP", re.I)


def is_noise(record: logging.LogRecord) -> bool:
    return bool(NOISE.search(record.name) or NOISE.search(record.getMessage()))


def is_own(record: logging.LogRecord) -> bool:
    return record.name.split(".")[0] == __name__.split(".")[0]


def configure(folder: str) -> list[logging.Handler]:
    """Sets the handlers of the driver's root logger, in place of those set before."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    root = logging.getLogger()
    for handler in [h for h in root.handlers if getattr(h, "tesserae", False)]:
        root.removeHandler(handler)
        handler.close()
    files = [logging.handlers.RotatingFileHandler(Path(folder, name), maxBytes=SIZE, backupCount=KEPT, encoding="utf-8") for name in ("all.log", "own.log")]
    made: list[logging.Handler] = [logging.StreamHandler(), *files]
    for handler, level, keep in zip(made, (logging.WARNING, logging.INFO, logging.DEBUG), (lambda r: not is_noise(r), lambda r: not is_noise(r), is_own), strict=True):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter(FORMAT))
        handler.addFilter(keep)
        handler.tesserae = True
        root.addHandler(handler)
    root.setLevel(logging.DEBUG)
    return made
