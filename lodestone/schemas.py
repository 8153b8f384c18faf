"""Declared schemas of what the engine reads and writes."""

from __future__ import annotations

QUESTION = (
    "question_id string, company string, doc_name string, question string, answer string, justification string, question_type string, question_reasoning string, "
    "evidence array<struct<evidence_doc_name:string,evidence_page_num:int,evidence_text:string,evidence_text_full_page:string>>"
)
PAGE = "doc_name string, page int, text string, company string, doc_type string, doc_period string, page_number_1based int, text_length int, extraction_status string"
CHUNK = (
    "chunk_id string, doc_name string, page int, text string, retrieval_text string, company string, fiscal_year int, document_type string, chunk_index int, "
    "token_start int, token_end int, char_start int, char_end int, content_capacity int"
)
MANIFEST = (
    "doc_name string, company string, doc_type string, doc_period string, source_url string, local_path string, download_status string, resolved_url string, "
    "download_source string, http_status int, file_size_bytes long, sha256 string, pdf_pages int, error string"
)
ANSWER = (
    "question_id string, architecture string, question string, gold_answer string, generated_answer string, retrieved_chunks array<struct<rank:int,chunk_id:string,doc_name:string,page:int,text:string,score:double>>, "
    "retrieval_latency_ms double, reranking_latency_ms double, generation_latency_ms double, total_latency_ms double"
)
#: Indices that carry another version are refused.
INDEX_VERSION = 1
