"""End-to-end pipelines and the catalogue of checked queries."""
