"""Reasoning-data curation on Spark: score, balance, order and evaluate QA data."""

from gradus.functions.completions import parse_extraction, parse_option_analysis
from gradus.functions.prompts import build_prompts
from gradus.operators.binning import error_rate, histogram, select_per_bin
from gradus.operators.generate import generate_batch
from gradus.operators.joins import anti_join_done, attach_scores, upsert
from gradus.operators.metrics import classification_report, metrics
from gradus.operators.ordering import assign_ids, with_position
from gradus.operators.quantiles import quantile
from gradus.operators.scoring import score_items, score_stats
from gradus.plans.sampling import sampling_plan
from gradus.shipping import ship
from gradus.sources.commits import append_results, read_results
from gradus.sources.readers import accepted, read_items, rejected

__all__ = [
    "accepted",
    "anti_join_done",
    "append_results",
    "assign_ids",
    "attach_scores",
    "build_prompts",
    "classification_report",
    "error_rate",
    "generate_batch",
    "histogram",
    "metrics",
    "parse_extraction",
    "parse_option_analysis",
    "quantile",
    "read_items",
    "read_results",
    "rejected",
    "sampling_plan",
    "score_items",
    "score_stats",
    "select_per_bin",
    "ship",
    "upsert",
    "with_position",
]
