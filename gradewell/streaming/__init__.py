from gradewell.streaming.stream_score import (read_reports, read_totals, stream_lines, stream_reports, stream_standardization,
                                              stream_tasks, stream_totals)

__all__ = ["read_reports", "read_totals", "stream_lines", "stream_reports", "stream_standardization", "stream_tasks", "stream_totals"]
