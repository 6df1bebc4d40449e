"""Small corpora written as the tables of a data directory."""

from __future__ import annotations

from datetime import date

SCHEMAS = {
    "source_document": "id string, source_identity string, source_type string, source_url string, original_relative_path string, aliases array<string>, active_build_id string",
    "source_revision": "id string, source_document_id string, raw_file_hash string",
    "document_build": "id string, source_revision_id string, processing_fingerprint string, decision string, processing_state string",
    "interview": "id string, build_id string, company_normalized string, position_normalized string, job_family string, language_tags array<string>, round string, interview_date date, publish_date date, analytics_eligible boolean",
    "canonical": "id string, canonical_text string, primary_topic_id string, question_type string",
    "occurrence": "id string, interview_id string, canonical_question_id string, question_type string, topic_id string, question_order int",
}
SEED = (
    ("1", "字节", "FIRST", date(2026, 8, 1), "fast", "redis.performance"),
    ("2", "腾讯", "SECOND", date(2026, 8, 2), "fast", "redis.performance"),
    ("3", "字节", "SECOND", None, "persistence", "redis.persistence"),
)


def write(spark, path: str, tables: dict[str, list[tuple]]) -> str:
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path


def seed_tables(extra: list[tuple] = ()) -> dict[str, list[tuple]]:
    """Three sources with one question each; ``extra`` are more occurrences of interview 1: (id, canonical, type, topic)."""
    t: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    for n, company, rnd, day, canonical, topic in SEED:
        t["source_document"].append((f"s{n}", f"post:{n}", "post", None, f"p{n}.md", [], f"b{n}"))
        t["source_revision"].append((f"r{n}", f"s{n}", f"{n:>064}"))
        t["document_build"].append((f"b{n}", f"r{n}", "f", "INCLUDED", "READY"))
        t["interview"].append((f"i{n}", f"b{n}", company, None, "BACKEND", ["Java"], rnd, day, None, True))
        t["occurrence"].append((f"o{n}", f"i{n}", canonical, "PRINCIPLE", topic, 1))
    t["canonical"] = [("fast", "Redis为什么快？", "redis.performance", "PRINCIPLE"), ("persistence", "Redis持久化方式？", "redis.persistence", "PRINCIPLE")]
    for k, (i, canonical, kind, topic) in enumerate(extra):
        t["occurrence"].append((i, "i1", canonical, kind, topic, 2 + k))
    t["canonical"] += [(c, c, "algo.x", "CODING") for c in sorted({e[1] for e in extra} - {"fast", "persistence"})]
    t["occurrence"].append(t["occurrence"][0])  # delivered twice
    t["interview"].append(t["interview"][1])
    return t
