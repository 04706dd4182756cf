"""docsheaf: document-evidence analytics as Spark DataFrame jobs."""
