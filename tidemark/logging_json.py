"""Log records as lines of JSON, for programs that want them so; the engine itself doesn't set up logging."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

_KNOWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime", "exc_text", "taskName"}


class JsonFormatter(logging.Formatter):
    """One JSON object a line: time in UTC, level, logger, message, place in the source, exception, extra fields."""

    def format(self, record: logging.LogRecord) -> str:
        line = {
            "timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name,
            "message": record.getMessage(), "module": record.module, "function": record.funcName, "line": record.lineno,
        }
        if record.exc_info and record.exc_info[0]:
            line |= {"exception": self.formatException(record.exc_info), "exception_type": record.exc_info[0].__name__}
        line |= {k: v for k, v in vars(record).items() if k not in _KNOWN and not k.startswith("_")}
        return json.dumps(line, default=str)
