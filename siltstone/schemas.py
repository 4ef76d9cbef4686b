"""Row types of documents, chunks, index rows, cases, answers, judgments and reports, as DDL."""

SECTION = "struct<section: string, text: string>"
PAGE = "struct<page: int, text: string>"
IDENTITY = "struct<seller_id: string, document_id: string, version: string, section: string>"


CATALOG = (
    "corpus_id string, corpus_version string, created_at string, notes string, sellers array<struct<seller_id: string, seller_name: string, "
    "documents: array<struct<document_id: string, document_name: string, policy_type: string, version: string, format: string, path: string, created_at: string, updated_at: string>>>>"
)
DOCUMENT = (
    "seller_id string, document_id string, document_name string, policy_type string, section string, version string, created_at string, updated_at string, "
    f"source_format string, source_path string, text string, sections array<{SECTION}>, pages array<{PAGE}>"
)
#: The columns of DOCUMENT, in order.
DOCUMENT_COLUMNS = (
    "seller_id", "document_id", "document_name", "policy_type", "section", "version", "created_at", "updated_at", "source_format", "source_path", "text", "sections", "pages",
)
CHUNK = (
    "seller_id string, document_id string, document_name string, policy_type string, version string, created_at string, updated_at string, source_format string, source_path string, "
    "section string, page int, chunk_position int, start int, `end` int, text string"
)
INDEX = (
    "seller_id string, chunk_id string, document_id string, version string, chunk_position int, text string, metadata string, embedding array<double>, embedding_model string, embedding_dimensions int"
)
_CASE = (
    ("case_id", "string"), ("category", "string"), ("seller_id", "string"), ("query", "string"), ("answerable", "boolean"), ("expected_sources", "array<string>"),
    ("expected_source_identity", "array<struct<seller_id: string, document_id: string, version: string, document_name: string, section: string>>"),
    ("expected_answer_points", "array<string>"), ("notes", "string"),
)
CASE = ", ".join(f"{n} {t}" for n, t in _CASE)
DATASET = (
    "dataset_id string, dataset_version string, corpus_id string, corpus_version string, distribution map<string,int>, cases array<struct<" + ", ".join(f"{n}: {t}" for n, t in _CASE) + ">>"
)
ANSWER = ("answer string, evidence_ids array<string>, citations array<struct<evidence_id: string, document_name: string, section: string, page: int>>")
JUDGMENT = (
    "faithful boolean, relevant boolean, citation_correct boolean, available_answer_point_indices array<int>, covered_answer_point_indices array<int>, unsupported_claims array<string>"
)
CALIBRATION = ("case_id string, split string, unsupported_sentence string")
EVIDENCE_RECORD = (
    "task_id string, gate string, command array<string>, timeout_seconds int, timed_out boolean, timestamp string, snapshot_sha256 string, exit_code int, status string, stdout string, stderr string"
)
TASK = (
    "id string, name string, description string, parent string, status string, blocker string, dependencies array<string>, required_gates array<string>, evidence array<string>, "
    "spec_sections array<string>, acceptance_criteria array<string>"
)
