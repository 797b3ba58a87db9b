"""Topic-keyed telemetry on Spark: batches, dictionaries, frames, drift and delivery analytics as DataFrame operators."""

from .functions.auth import hmac_hex, sign_frames, verify_frames
from .functions.checks import (
    observe_outcomes, outcome_counts, quarantine, quarantine_counts, validate_dict_id, validate_header, validate_sizes, validate_topic)
from .functions.normalize import normalize
from .functions.scalars import dict_file_name, dict_id, pressure_cols, ratio_cols, trained_dict_id
from .operators.batching import assign_batches, build_batches, payload_size
from .operators.breaker import breaker_health, breaker_states, breaker_stats
from .operators.codec import (
    compress_batches, compression_report, compression_report_wide, decode_frames, frame_lines, reconcile, train_dicts,
    train_global_dict)
from .operators.delivery import evict_pending, merge_delivery, oldest_pending, pending_stats, settle
from .operators.drift import ema, monitor_stats, ratio_baseline, ratio_events
from .operators.metrics import (
    batch_latency, error_counts, health_snapshot, metrics_csv, metrics_report, overall_metrics, running_metrics,
    topic_metrics)
from .operators.pressure import queue_depth, queue_stats
from .operators.registry import (
    active_versions, attach_active_dict, attach_dict_by_id, budget_prefix, dict_as_of, gc_report, gc_versions,
    publish_versions, registry_stats, registry_totals, retrain_candidates, sample_stats, sample_window,
    training_readiness, unknown_dicts)
from .operators.timeline import outage_latency, phase_summary, rates, state_intervals, timeline_curves
from .session import SETTINGS, local_session, scratch_table
from .sources.files import (
    log_events, read_log_events, read_messages, read_samples, read_timeline, sample_files)
from .sources.frames import encode_frames, read_frame_table, read_frames, split_frames
from .sources.registry_store import (
    change_registry, current_registry, expire_snapshots, index_report, index_to_registry, publish_snapshot, read_dict_index,
    write_dict_files, write_dict_index)
from .sources.sinks import frame_metrics, write_metrics, write_topic_jsonl
from .streaming.flows import (
    decode_sink, ingest, metrics_sink, retrain_step, run_available, run_each, stream_metrics, window_metrics)
from .streaming.stateful import stream_batches, stream_breaker, stream_monitor

__all__ = [name for name in dir() if not name.startswith("_")]
