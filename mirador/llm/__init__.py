"""Training-data operators over documents, pages, conversations and embeddings."""

from .registry import ORACLES, QUERIES
from . import ann, bpe, chat, collocations, langid, linefreq, lm, mixing, neardup, negatives, packing, urls, warc  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
