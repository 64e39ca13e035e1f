"""Parking-operations analytics on Spark DataFrames."""

from lotline.schemas import TABLES, struct_of
from lotline.session import build_session
from lotline.sources.tables import Tables

__all__ = ["TABLES", "Tables", "build_session", "struct_of"]
