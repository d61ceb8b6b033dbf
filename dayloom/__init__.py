"""dayloom: keyed daily panels on Spark.

Sub-packages
------------
``sources``    scans, landed documents, high-water marks and sinks
``functions``  column builders (dates, text, numbers)
``operators``  DataFrame -> DataFrame operators on panels, models, forecasts
``streaming``  Structured Streaming forms of the daily roll-up, load and upsert
``plans``      end-to-end pipelines and the catalogue of checked queries
"""

from dayloom.session import build_session, materialise, scratch_path

__all__ = ["build_session", "materialise", "scratch_path"]
