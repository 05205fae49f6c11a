"""Differentially private analytics on Spark DataFrames."""

from .functions.binning import BinningSpec
from .budget import ApproxDPBudget, PrivacyBudget, PureDPBudget, RhoZCDPBudget
from .config import config
from .keyset import KeySet, KeySetPlan
from .operators.noise import AverageMechanism, CountDistinctMechanism, CountMechanism, StdevMechanism, SumMechanism, VarianceMechanism
from .protect import AddMaxRows, AddMaxRowsInMaxGroups, AddOneRow, AddRowsWithID, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, ProtectedChange, TruncationStrategy
from .query_builder import GroupbyCountQuery, GroupedQueryBuilder, Query, QueryBuilder
from .session import Session
from .types import ColumnDescriptor, ColumnType

__all__ = [
    "AddMaxRows", "AddMaxRowsInMaxGroups", "AddOneRow", "AddRowsWithID", "ApproxDPBudget", "AverageMechanism", "BinningSpec",
    "ColumnDescriptor", "ColumnType", "CountDistinctMechanism", "CountMechanism", "GroupbyCountQuery", "GroupedQueryBuilder", "KeySet", "KeySetPlan",
    "MaxGroupsPerID", "MaxRowsPerGroupPerID", "MaxRowsPerID", "PrivacyBudget", "ProtectedChange", "PureDPBudget", "Query", "QueryBuilder",
    "RhoZCDPBudget", "Session", "StdevMechanism", "SumMechanism", "TruncationStrategy", "VarianceMechanism", "config",
]
