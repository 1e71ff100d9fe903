"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from doclake.plans.queries import all_queries  # noqa: E402
from doclake.session import local_session  # noqa: E402

HEADLINE = [
    "t1_counts", "t2_language_flag", "t4_metric_extraction", "t5_summary", "t6_ai_document",
    "l1_lines", "l3_paragraphs", "l4_headings", "l5_lists", "l7_key_sections", "l10_text_report",
    "s7_scan_requests", "p2_route", "p7_render_mode", "e1_result_row", "e2_reject_row",
    "d2_column_types_all_rows", "d4_completeness", "d5_preview_table", "d6_full_table",
    "n1_nodes", "n2_tree_stats", "n4_outline", "n5_tree_report", "n6_config_patterns",
    "x1_elements", "x2_xml_stats", "x3_tag_summary", "x5_xml_report",
    "g2_cell_census", "g7_table_rows", "g8_sheet_preview", "g12_workbook_report",
    "m1_clean_chars", "m4_merge_fences", "m5_text_tables", "m6_pipe_tables", "m9_code_blocks", "m12_normalise", "m14_markdown_lint",
    "r1_corpus_profile", "r2_metric_frequency", "r3_tag_inventory", "r4_key_inventory", "st1_request_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors outside the timings
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if only:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
