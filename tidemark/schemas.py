"""Table schemas.  Keys are natural; uniqueness is kept by the upsert operators."""

from __future__ import annotations

EMPLOYERS = """
    employer_id bigint, employer_name string, url string, trusted boolean,
    first_seen_at timestamp
"""

SKILLS = "skill_name string, display_name string"

POSTINGS = """
    posting_id bigint, title string, employer_id bigint, area_id int, area_name string,
    salary_from int, salary_to int, salary_currency string, salary_gross boolean,
    salary_from_base int, salary_to_base int,
    experience_id string, experience_name string, employment_id string, schedule_id string,
    is_remote boolean, roles array<struct<id: string, name: string>>, description string,
    url string, published_at timestamp, created_at timestamp, archived boolean,
    fetched_at timestamp, detail_fetched_at timestamp
"""

LINKS = "posting_id bigint, skill_name string"

CHUNKS = """
    posting_id bigint, chunk_index int, content string, char_len int,
    embedding array<float>, model_name string, embedded_at timestamp
"""

PROFILES = """
    title string, experience_years double,
    skills array<struct<name: string, level: string>>, missing array<string>,
    constraints struct<salary_min_base: bigint, remote_only: boolean, relocation: boolean,
                       employment: array<string>, max_experience: string,
                       english_speaking: boolean>,
    red_flags array<string>, green_flags array<string>
"""

QUERY_SET = """
    query_id string, query string, intent string,
    relevant_ids array<bigint>, patterns array<string>
"""

TABLES = {
    "employers": EMPLOYERS,
    "skills": SKILLS,
    "postings": POSTINGS,
    "links": LINKS,
    "chunks": CHUNKS,
}
