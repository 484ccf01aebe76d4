"""Row types of the engine.

Field names, widths and the kinds of errors are those of tile lists and journals as they are exchanged (fixed values).
"""

PIXEL_BYTES = {"float32": 4, "float64": 8, "int16": 2, "int32": 4, "uint8": 1, "uint16": 2}
ERROR_KINDS = ("MEMORY_EXCEEDED", "COMPUTATION_TIMEOUT", "RATE_LIMITED", "RETRYABLE_SERVER", "FATAL_REQUEST", "AUTH_ERROR", "UNKNOWN")
SPLIT_KINDS = ("MEMORY_EXCEEDED", "COMPUTATION_TIMEOUT")
RETRY_KINDS = ("RATE_LIMITED", "RETRYABLE_SERVER", "UNKNOWN")
TERMINAL_KINDS = ("FATAL_REQUEST", "AUTH_ERROR")

TILE = "col_px int, row_px int, width_px int, height_px int, row int, col int, out_row int, out_col int, lineage array<int>"
TILE_COLUMNS = ("col_px", "row_px", "width_px", "height_px", "row", "col", "out_row", "out_col", "lineage")
REQUIRED = ("col_px", "row_px", "width_px", "height_px", "row", "col")
JOURNAL = TILE + ", error_kind string, error_message string, http_status int, attempts int, first_seen string, last_seen string, journal_reason string"
FETCHED = TILE + ", payload binary, error_kind string, error_message string, http_status int, attempts int"
