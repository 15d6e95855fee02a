"""Row types of the engine's tables, as DDL."""

from __future__ import annotations

CHUNK = (
    "doc_id string, chunk_index int, text string, source_file string, chunk_type string, section_title string, "
    "page_numbers array<int>, block_types array<string>, token_count int, parent_text string, parent_token_count int, "
    "parent_window_start int, parent_window_end int, metadata map<string,string>"
)
#: What the store keeps of a chunk.
PAYLOAD = "text", "chunk_index", "doc_id", "source_file", "chunk_type", "section_title", "page_numbers", "token_count", "metadata"
NODE = "type string, level int, text string, breadcrumb string"
BLOCK = "type string, text string, text_format string, img_path string, table_body string, page_idx int"
TURN = "session_id string, user_id string, turn bigint, role string, content string, timestamp timestamp, metadata map<string,string>"
EPISODE = "user_id string, session_id string, summary string, topic_tags array<string>, turn_count int, created_at timestamp"
STATE = (
    "session_id string, user_id string, question string, effective_query string, was_rewritten boolean, question_category string, "
    "complexity int, sub_questions array<string>, idx int, round int, max_rounds int, steps int, route string"
)
