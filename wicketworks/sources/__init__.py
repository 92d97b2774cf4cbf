"""Reading the ball and match tables, reading and writing the marts."""

from wicketworks.sources.files import file_order, read_csv, read_deliveries, read_matches, reject_count, rejected
from wicketworks.sources.marts import read_mart, write_mart

__all__ = [
    "file_order",
    "read_csv",
    "read_deliveries",
    "read_mart",
    "read_matches",
    "reject_count",
    "rejected",
    "write_mart",
]
