"""Named queries. Importing this package fills the registry."""

from terraloom.plans import document_queries, forecast_queries, grid_queries, learned_queries, scene_queries, landing_queries, source_queries, station_queries, stream_queries  # noqa: F401
