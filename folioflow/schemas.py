"""The records. Lists are rows with a dense `pos` from 0; a DataFrame alone has no order."""

RECENT = "path STRING, name STRING, last_opened TIMESTAMP, size BIGINT, page_count BIGINT"
DOC_INFO = "path STRING, name STRING, size BIGINT, page_count BIGINT, version STRING"
REQUEST = "pos BIGINT, path STRING, page_range STRING"
NOTIFICATION = "id STRING, type STRING, title STRING, message STRING, ts TIMESTAMP, read BOOLEAN"
SPAN = "id STRING, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, font_size DOUBLE, font_family STRING, color STRING"

#: Fixed values.
VERSION = "1.0"
RECENTS_KEPT = 20
TOASTS_SHOWN = 5
TTL_SECONDS = 5
DEFAULT_OUTPUT = "document.pdf"
DATA_URL_HEAD = "data:application/pdf;base64,"
