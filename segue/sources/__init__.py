from segue.sources.readers import (  # noqa: F401
    read_csv_gz, read_csv_rows, read_json_lists, read_key_value, read_lines, read_row_range, read_sep_tracks,
    read_triplets, unnest_tracks,
)
from segue.sources.writers import (  # noqa: F401
    indexed_lines, write_indexed_lines, write_submission, write_table,
)
