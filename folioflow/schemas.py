"""Table schemas, as DDL strings."""

KEYWORD_HITS = "query_id long, rank int, file_id long, full_path string, target_path string, file_name string, snippet string, utility_score double, click_count double"
CHANGES = "path string, op string, content string, mtime timestamp"
