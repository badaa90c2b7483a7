"""Relations that the operators take and return, as DDL."""

DOCS = "uri string, load_ord bigint, text string"
LINES = "uri string, load_ord bigint, ln int, line string"
DEFS = "id string, uri string, load_ord bigint, ln int, col int"
REFS = "id string, uri string, ln int, col int"
FILE_REFS = "path string, uri string, ln int, col int"
SYMBOLS = "uri string, name string, ln int, level int, kind string"
ATTRS = "uri string, name string, value string"
DIAGNOSTICS = "uri string, code string, severity string, message string, ln int, col int, end_col int"
CELLS = "table_id string, r int, c int, v string"
SEVERITIES = ("hint", "info", "warning", "error", "fatal")
