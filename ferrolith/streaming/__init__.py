"""The page pipeline and event summaries over streams."""
