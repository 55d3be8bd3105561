"""Tool-use workflow data on Spark: catalogs, traces, chat samples, splits and scores."""
