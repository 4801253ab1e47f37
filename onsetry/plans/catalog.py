"""All registered queries; importing the modules registers them."""

from onsetry.plans import q_cohort, q_edges, q_modelling, q_normalize, q_ranking, q_sequences, q_sources, q_traces  # noqa: F401
from onsetry.plans.registry import ORACLES, QUERIES  # noqa: F401
