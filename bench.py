"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores and
``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import time

from lorespark.plans.catalog import QUERIES
from lorespark.session import local_session
from lorespark.sources.tables import READ_PARTS

HEADLINE = [
    "flagship_ranked_answers", "a3_fingerprints", "a6_exact_dedup", "b1_clean_text", "b2_normal_keys",
    "c2_paragraphs", "c3_paged_sections", "c4_markdown_block_counts", "c8_html_blocks", "c9_section_paths",
    "d1_packed_paragraphs", "d4_fixed_windows", "d4_boundary_windows", "d5_structural_chunks", "d8_span_map",
    "d12_chunk_set_rollup", "e1_classify_documents", "e2_keyword_search", "e4_detect_categories",
    "f1_sentences", "f5_concept_candidates", "f8_claims", "g3_neighbourhood", "h3_version_flags",
    "h6_supersedes_chains", "i1_transition_legality", "i3_attempts", "j3_course_progress",
    "j7_automatic_grading", "j14_lesson_progress", "k1_repeated_keys", "k5_orphans",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    # the bench's text tables are single row groups, which one core would read alone
    spark = local_session(cores, shuffle_partitions=cores, **{READ_PARTS: str(2 * cores)})
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    # one small query starts the JVM's code paths and the Python workers
    QUERIES["b2_normal_keys"](spark, folder).limit(1).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_ALL"):
            print(f"{name:36}{times[name]:8.2f}", flush=True)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
