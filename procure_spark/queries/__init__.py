"""Queries of the library's operators over the driver's tables."""

from procure_spark.queries import joins, more, relational, rows, text, whole

flagship = joins.q07_match_analogs

__all__ = ["flagship", "joins", "more", "relational", "rows", "text", "whole"]
