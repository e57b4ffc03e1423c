"""Schemas of the main entities."""

SECTION = (
    "struct<term:string,catalog_ref:string,course_number:string,section_call_number:string,times:string,location:string,instructor:string,"
    "points:string,enrollment_raw:string,enrollment_current:int,enrollment_capacity:int>"
)
COURSE = (
    "dedup_key string, course_uid string, bulletin_year string, source_page_url string, source_page_title string, department_or_group string, course_code string, "
    "title string, points_raw string, points_min double, points_max double, description string, description_source string, prerequisites_text string, "
    f"prerequisites_source string, notes_text string, sections array<{SECTION}>, needs_review boolean, parse_warnings array<string>, raw_title_text string, "
    "course_review_warnings array<string>, section_review_warnings array<string>"
)
REGISTRY = "dedup_key string, bulletin_year string, course_code string, title string, source_page_url string, seen_count long, first_seen_at string, last_seen_at string"
OVERLAY = (
    "course_code string, term string, section_id string, version_id string, source_hash string, status string, created_at_ns long, revision int, "
    "payload map<string,string>, seed_course_uids array<string>"
)
SOURCE_RECORD = "uid string, course_code string, title string, citation_label string, role string"
EVENT = "type string, content string"
