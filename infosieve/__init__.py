"""infosieve: information-theoretic feature selection on Spark DataFrames."""

from .operators.cells import (ArrayInstances, FeatureWise, MapInstances, VectorInstances, WideInstances, layout_for,
                              to_cells)
from .operators.bitmaps import BitmapCells
from .operators.scores import MIQ, MRMR, CellTerm, ExprScore, JointAgg, MaxRelevance, RankTerm, Score, TablesTerm, VectorAgg, get_score, register_score
from .operators.selection import Selector, select_features
from .session import build_session, ensure_checkpoint_dir

__all__ = ["ArrayInstances", "FeatureWise", "MapInstances", "VectorInstances", "WideInstances", "layout_for", "to_cells", "MIQ", "MRMR",
           "BitmapCells", "CellTerm", "ExprScore", "JointAgg", "MaxRelevance", "RankTerm", "Score", "TablesTerm", "VectorAgg", "get_score", "register_score", "Selector",
           "select_features", "build_session", "ensure_checkpoint_dir"]
