"""Declared schemas of the archive tables; nothing is inferred."""

from pyspark.sql import DataFrame, SparkSession

#: Columns and types, as Spark's readers take them.
SCHEMAS: dict[str, str] = {
    "emails": "id string, message_id string, thread_id string, source_account string, import_id string, subject string, sender_name string, sender_address string, sender_domain string, recipients struct<to:array<string>,cc:array<string>,bcc:array<string>>, date timestamp, body_text string, body_html string, has_attachment boolean, attachments array<struct<filename:string,content_type:string,size:bigint>>, labels array<string>, in_reply_to string, references array<string>, embedding array<float>, created_at timestamp",
    "email_accounts": "email_id string, source_account string, import_id string, first_seen_at timestamp",
    "imports": "id string, source_account string, source_file string, started_at timestamp, completed_at timestamp, messages_total int, messages_inserted int, messages_skipped int, status string",
    "attachments": "id string, sha256 string, filename string, content_type string, size bigint, storage_path string, reference_count int",
    "email_attachments": "email_id string, attachment_id string, filename string",
    "attachment_contents": "attachment_id string, status string, markdown string, markdown_bytes bigint, reason string, extracted_at timestamp, extraction_ms int, extractor_version string",
    "attachment_chunks": "id bigint, attachment_id string, chunk_index int, heading_path string, page_number int, token_count int, text string, embedding array<float>",
    "contacts": "id string, display_name string, kind string, kind_source string, tags array<string>, notes string, metadata string, human_probability double, classification_signals map<string,double>",
    "contact_addresses": "address string, contact_id string, name_variants array<string>, is_user boolean, first_seen timestamp, last_seen timestamp, messages_from bigint, messages_to bigint",
    "topics": "id string, label string, origin string, parent_id string, hidden boolean, centroid array<double>, top_terms array<string>, generation int, member_count bigint",
    "topic_members": "topic_id string, email_id string, distance double, origin string",
    "app_events": "id string, title string, time_start timestamp, time_end timestamp, time_precision string, origin string, event_type string, status string, evidence_strength string, scope_fingerprint string, current_version int",
    "event_versions": "event_id string, version int, author string, title string, summary string",
    "event_claims": "event_id string, version int, position int, text string, status string, citations array<struct<source_id:string,source_type:string,excerpt:string,excerpt_hash:string>>",
}


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """An archive table from Parquet with its declared schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)
