"""doclake: document admission, Markdown repair, table extraction and job-log analytics as Spark jobs."""
