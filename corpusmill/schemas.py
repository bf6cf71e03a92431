"""Column orders of the stored tables, and checks against them.

Fixed values: the column names and their order are the file format.
"""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = {
    "ledger": "ts_utc run_id phase status tokenizer_version vocab_size tokenizer_sha256 model init_method seed target_tokens tokens_seen raw_bytes_seen wall_sec peak_vram_mb git_commit git_dirty config_sha256 manifest_sha256 env_sha256 argv note model_revision embedding_share clock_check_sha256 tokens_applied raw_bytes_applied updates peak_reserved_mb",
    "models": "ts_utc name repo_id revision role scope vocab_size tokenizer_len hidden_size n_layers n_heads n_kv_heads head_dim embedding_params total_params embedding_share tie_word_embeddings kv_bytes_per_token files_mb note",
    "clock_checks": "ts_utc clock_check_sha256 status server server_utc local_midpoint_utc offset_ms rtt_ms windows_source method git_commit note",
    "artifacts": "ts_utc artifact_id run_id kind name path artifact_sha256 size_bytes model_revision tokenizer_version manifest_sha256 git_commit note",
    "tokenizer_metrics": "ts_utc run_id tokenizer_version tokenizer_sha256 split domain n_docs n_chars n_bytes n_eojeol n_tokens tok_per_char tok_per_byte bytes_per_tok tok_per_eojeol fertility_mean p50_len p90_len p95_len p99_len max_len git_commit config_sha256",
    "lm_metrics": "ts_utc run_id checkpoint tokens_seen raw_bytes_seen split domain n_bytes total_nll bpb bpc token_ppl git_commit config_sha256",
    "capability": "ts_utc run_id checkpoint benchmark lang n_items n_shot metric value ci_lo ci_hi git_commit config_sha256",
    "system_bench": "ts_utc run_id model tokenizer_version mode raw_chars raw_bytes input_tokens gen_tokens n_warmup n_runs tokenize_ms_mean prefill_ms_mean prefill_ms_p95 ttft_ms_mean ttft_ms_p95 decode_tok_s_mean total_ms_mean total_ms_std kv_cache_mb_est peak_alloc_mb peak_reserved_mb git_commit config_sha256 batch_size throughput_docs_s",
    "train_curve": "ts_utc run_id step tokens_seen raw_bytes_seen train_loss dev_loss dev_bpb lr grad_norm grad_norm_emb grad_norm_attn grad_norm_ffn peak_vram_mb tok_per_s raw_bytes_per_s elapsed_sec git_commit config_sha256 grad_norm_head grad_norm_dmg upd_w_ratio_dmg",
    "env_snapshot": "ts_utc env_sha256 python torch cuda cudnn transformers tokenizers datasets accelerate bitsandbytes peft numpy driver gpu_name vram_mb change_note kiwipiepy psutil attn_backend",
    "manifest": "doc_id source domain date language sha256 split char_count byte_count latin_share hangul_ratio",
}
TABLES = {name: columns.split() for name, columns in TABLES.items()}
REQUIRED = {
    "ledger": {"run_id", "phase", "status"},
    "tokenizer_metrics": {"run_id", "tokenizer_version", "split", "domain"},
    "lm_metrics": {"run_id", "split", "domain", "bpb"},
    "capability": {"run_id", "benchmark", "metric", "value"},
    "system_bench": {"run_id", "model", "mode"},
    "train_curve": {"run_id", "tokens_seen"},
    "env_snapshot": {"env_sha256"},
    "models": {"name", "repo_id", "revision"},
    "clock_checks": {"clock_check_sha256", "status", "server"},
    "artifacts": {"artifact_id", "kind", "name", "path", "artifact_sha256"},
}
METRICS = ["tokenizer_metrics", "lm_metrics", "capability", "system_bench", "train_curve"]
STATUSES = ["start", "ok", "fail", "abort"]
TERMINAL = ["ok", "fail", "abort"]
PHASES = ["data", "tok", "surgery", "align", "cpt", "eval", "sys"]
DOMAINS = ["news", "encyclopedia", "blog", "community", "conversational", "technical", "ko_en_mixed", "code", "noisy", "web_general"]
KINDS = ["tokenizer", "checkpoint", "adapter", "manifest_summary", "table", "figure", "report", "other"]
SPLITS = ["train", "dev", "final_test"]
MISSING = "NA"


def text_schema(table: str) -> T.StructType:
    """Every field of a stored table is text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in TABLES[table]])


def check_row(table: str, row: dict) -> None:
    """Unknown or missing columns raise ValueError."""
    if unknown := set(row) - set(TABLES[table]):
        raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
    if missing := {c for c in REQUIRED.get(table, ()) if row.get(c) in (None, "", MISSING)}:
        raise ValueError(f"{table} needs {', '.join(sorted(missing))}")
