"""All registered queries; importing the modules fills the registry."""

from armparity.plans import q_cost, q_gates, q_io, q_judge, q_keys, q_metrics, q_reports, q_sampling, q_shadow, q_stats, q_text  # noqa: F401
from armparity.plans.registry import ORACLES, QUERIES  # noqa: F401
