"""The queries over the driver's tables and the SQL that each is held against."""

from folium.plans import job_queries, layout_queries, stream_queries, text_queries

PARTS = (text_queries, layout_queries, job_queries, stream_queries)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
