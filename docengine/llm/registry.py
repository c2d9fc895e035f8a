"""The queries of this subpackage and their SQL."""

from . import chaining, chat, circulant, decontaminate, lexical, mixing, negatives, pii, quality, secrets, simhash, suffix, topk

MODULES = (chaining, simhash, mixing, pii, suffix, quality, topk, decontaminate, chat, secrets, negatives, lexical, circulant)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
