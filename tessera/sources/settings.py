"""Logging set up from a file, as the reference does; paths and sizes are parameters of the operators."""

from __future__ import annotations

import json
import logging
import logging.config

FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def setup_logging(path: str, level: int = logging.INFO) -> bool:
    """Apply the dictConfig in a JSON file; on any error log to the console at ``level`` and give False."""
    try:
        with open(path, encoding="utf-8") as f:
            logging.config.dictConfig(json.load(f))
    except Exception as e:
        logging.basicConfig(level=level, format=FORMAT)
        logging.getLogger(__name__).warning("logging configuration %s not used: %s", path, e)
        return False
    return True
