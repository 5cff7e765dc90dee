"""All registered queries of the subpackage."""

from riskframe.llm import (  # noqa: F401
    q_chats,
    q_decontam,
    q_langid,
    q_licenses,
    q_linededup,
    q_merkle,
    q_neardup,
    q_pieces,
    q_quality,
    q_rolefix,
    q_sharding,
    q_toxicity,
    q_warc,
)
from riskframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
