"""Seconds per headline query at one scale directory; prints one JSON line."""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracework.plans import load_all  # noqa: E402
from tracework.plans.registry import QUERIES  # noqa: E402
from tracework.session import build_session  # noqa: E402

HEADLINE = (
    "tool_wear_windows", "join_asof_nearest", "join_asof_unkeyed", "join_index_aligned", "flt_depth_gate", "prj_tke_budget",
    "agg_window12", "agg_describe", "agg_effect_size", "agg_bin_mean_two_level", "agg_time_frame", "win_count_size", "win_gap_session",
    "seg_rising_edge", "win_sliding_slope", "seg_longest_run", "ftd_longest_strike_above_mean", "ftd_linear_trend_slope", "sig_rfft",
    "ffd_spectral_peaks", "fst_basic", "fw_window11", "sig_cell_lines", "sig_line_psd", "sig_interp_profile", "ev_compare_models", "fus_scores",
    "vec_knn_mean_dist", "vec_patch_score", "ml_pca_recon", "txt_parse_articles_blocks", "txt_main_points", "chk_hash_dedup", "chk_recursive",
    "ret_bm25", "ret_hybrid_rrf", "cnv_history", "exp_call_method",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["tool_wear_windows"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    load_all()
    main()
