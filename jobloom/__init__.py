"""Job-posting analytics as Spark jobs: mapping, dedup, upserts, text, pages, streams."""
