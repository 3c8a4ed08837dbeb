"""All registered queries of the subpackage."""

from orbivec.llm import chat, decontaminate, importance, licenses, lm, pack, quality, secrets, simhash, spelling, superminhash, topk, urls  # noqa: F401
from orbivec.llm.registry import ORACLE, QUERIES  # noqa: F401
