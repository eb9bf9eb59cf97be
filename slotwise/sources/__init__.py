from .csvlog import read_cancelled, read_completed
from .events import case_log, read_events
from .sink import write_result

__all__ = ["case_log", "read_cancelled", "read_completed", "read_events", "write_result"]
