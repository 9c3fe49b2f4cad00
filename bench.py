"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["src1_annotation_scan", "a1_split_class_counts", "a10_nested_histograms", "src14_snapshot_drift", "j3_iou_pairs", "j4_greedy_match",
            "a16_image_scores", "a18_average_precision", "j6_attach_values", "j7_crowding", "str12_validation", "grf1_connected_components",
            "grf5_trace", "grf3_equivalence", "j9_photo_consistency", "j12_voltages_match", "a20_mode_subset_summary", "str8_character_accuracy",
            "seq1_best_tags", "seq5_clause_fold", "seq9_sentence_to_netlist", "a24_tag_scores", "a33_sequence_model"]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.environ.setdefault("WIRELAKE_PARTITIONS", str(2 * int(cpus)) if cpus.isdigit() else "16")
    from wirelake.plans import catalogue
    from wirelake.session import local_session
    spark = local_session(cpus, "bench")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for n in names:
        t = time.perf_counter()
        catalogue.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
        print(n, times[n], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
