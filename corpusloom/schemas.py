"""Schemas of documents and chunks, as DDL. Readers declare them; nothing is inferred."""

DOCUMENT = (
    "doc_id string, source_url string, source_name string, title string, section_headers array<string>, content string, content_type string, "
    "crawl_depth int, scraped_at timestamp, legal_citations array<string>, parent_url string, content_hash string"
)
CHUNK = (
    "chunk_id string, doc_id string, source_url string, source_name string, title string, content string, content_type string, "
    "legal_citations array<string>, chunk_index int, total_chunks int"
)
