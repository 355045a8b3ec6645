from revdiff.functions.address import address_col, address_row, col_index, range_tokens
from revdiff.functions.display import (
    ambiguous,
    base_name,
    cell_label,
    cell_marker,
    change_badges,
    escape_html,
    similarity_band,
    similarity_pct,
)
from revdiff.functions.rules import cf_changed, cf_display, dv_changed, dv_display, serial_date
from revdiff.functions.text import (
    extract_number,
    is_blank,
    normalize_text,
    strip_number_prefix,
    text_similarity,
    trim_ws,
)

__all__ = [
    "address_col", "address_row", "ambiguous", "base_name", "cell_label", "cell_marker",
    "cf_changed", "cf_display", "change_badges", "col_index", "dv_changed", "dv_display",
    "escape_html", "extract_number", "is_blank", "normalize_text", "range_tokens",
    "serial_date", "similarity_band", "similarity_pct", "strip_number_prefix",
    "text_similarity", "trim_ws",
]
