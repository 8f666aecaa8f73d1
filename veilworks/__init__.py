"""Log de-identification, timestamp re-basing, template catalogs and event synthesis as Spark jobs."""
