
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.plans.registry import load_all  # noqa: E402

IDS = {
    "S1": ["read_cases"], "S2": ["read_vehicles"], "S3": ["read_yearly_csv"], "S4": ["read_prediction_runs"],
    "S5": ["parse_run_tag", "model_tag_by_prefix"], "S6": ["profile_tables"], "S7": ["write_report"], "S8": ["append_scored"],
    "S9": ["head_n_per_file"],
    "C1": ["normalise_labels"], "C2": ["encode_labels", "label_mapping"], "C3": ["apply_encoding", "apply_encoding_strict"],
    "C4": ["remap_codes"], "C5": ["code_meaning"], "C6": ["unpivot_codebook"], "C7": ["parse_options"],
    "C8": ["local_code_encode"], "C9": ["local_code_decode"], "C10": ["sample_hash_id", "sample_id_occurrence"],
    "R1": ["explode_vehicles"], "R2": ["lookup_truth"], "R3": ["lookup_truth_text_key"], "R4": ["vehicle_examples"],
    "R5": ["eligibility", "eligibility_reasons"], "R6": ["category_options", "configuration_options"], "R7": ["truth_list"],
    "R8": ["single_vehicle_detail"],
    "T1": ["focus_vehicle"], "T2": ["split_by_vehicle"], "T3": ["build_prompts"], "T4": ["sft_examples_manner", "sft_examples_category", "sft_examples_configuration", "sft_examples", "sft_examples_first"],
    "T5": ["predict_table"], "T6": ["prompt_dedupe_cache"], "T7": ["parse_digit", "parse_failure_rate", "parse_failure_by_model"],
    "T8": ["parse_first_digit"], "T9": ["parse_letter"], "T10": ["parse_symbol"], "T11": ["argmax_class"],
    "T12": ["build_vocab"], "T13": ["encode_tokens"],
    "N1": ["inject_label_noise"], "N2": ["noise_ladder"], "N3": ["random_split"], "N4": ["stratified_split"],
    "N5": ["class_weights"], "N6": ["limit_sample_sweep"],
    "M1": ["accuracy"], "M2": ["macro_f1"], "M3": ["metrics_excl_class"], "M4": ["class_report"],
    "M5": ["confusion_matrix"], "M6": ["class_subset_dist"], "M7": ["label_share"], "M8": ["metrics_table"],
    "V1": ["vehicle_eval_cat"], "V2": ["vehicle_eval_conf"], "V3": ["vehicle_eval_type"],
    "V4": ["vehicle_correctness"], "V5": ["missed_vehicles"], "V6": ["extra_predictions"],
    "V7": ["gt_pred_lines"], "V8": ["case_accuracy"], "V9": ["vehicle_overall"], "V10": ["case_report", "case_report_detail"],
    "A1": ["merge_predictions"], "A2": ["pairwise_agreement"], "A3": ["pairwise_with_gt"],
    "A4": ["accuracy_vs_gt"], "A5": ["sample_consistency"], "A6": ["sample_consistency_gt"],
    "A7": ["overall_consistency"], "A8": ["fleiss_kappa", "fleiss_kappa_strict"], "A9": ["majority_vote"],
    "A10": ["self_consistency"], "A11": ["run_pairwise"], "A12": ["consistency_histogram"],
    "B1": ["embedding_lr", "embedding_lr_report", "embedding_lr_sizes"], "B2": ["bow_linear", "bow_linear_score"],
    "B3": ["noise_robustness", "noise_training_sizes"],
    "X1": ["incremental_scoring"],
}


def main() -> None:
    reg = load_all()
    missing = sorted(set(reg) - {k for ks in IDS.values() for k in ks})
    lines = ["| ID | query key(s) | oracle |", "|---|---|---|"]
    for i, keys in IDS.items():
        for k in keys:
            assert k in reg, k
        oracle = ", ".join("SQL" if reg[k].sql else "rows" for k in keys)
        lines.append(f"| {i} | {', '.join(f'`{k}`' for k in keys)} | {oracle} |")
    print("\n".join(lines))
    if missing:
        print("\nunmapped keys:", missing)


if __name__ == "__main__":
    main()
