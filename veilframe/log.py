"""Log lines as JSON that never hold data, keys or the text of errors."""

from __future__ import annotations

import json
import logging

#: Fields whose values are not written.
HIDDEN = ("key", "salt", "token", "secret", "password", "value", "values", "row", "rows", "cell", "data", "text")


def scrubbed(x):
    if isinstance(x, dict):
        return {k: "(hidden)" if str(k).lower() in HIDDEN else scrubbed(v) for k, v in x.items()}
    return [scrubbed(v) for v in x] if isinstance(x, (list, tuple)) else x if isinstance(x, (int, float, bool, type(None))) else str(x)


class Formatter(logging.Formatter):
    """One JSON object a line; of an exception its type alone."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info and record.exc_info[0]:
            out["error"] = record.exc_info[0].__name__
        if isinstance(extra := getattr(record, "fields", None), dict):
            out |= scrubbed(extra)
        return json.dumps(out, ensure_ascii=False)
