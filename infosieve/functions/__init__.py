"""Column expressions: entropy terms, the AND/OR tree label, score formatting."""

from .entropy import xlog2x
from .tree import tree_label
from .format import score_text

__all__ = ["xlog2x", "tree_label", "score_text"]
