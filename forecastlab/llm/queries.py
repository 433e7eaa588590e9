"""Every query of this subpackage."""

from __future__ import annotations

from forecastlab.llm import alignment, backoff, bit_search, chat_format, decontamination, jaccard_groups, quality_net, repair, secrets, sentence_pieces, sharding, token_counts, toxicity  # noqa: F401
from forecastlab.llm.registry import ORACLES, QUERIES  # noqa: F401
