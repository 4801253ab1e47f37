"""All corpus queries."""

from onsetry.llm import clustering, contamination, html_text, jaccard, language, lines, mixing, neighbours, prefix_trie, quality, secret_scan, sharding, substrings  # noqa: F401
from onsetry.llm.registry import ORACLES, QUERIES  # noqa: F401
