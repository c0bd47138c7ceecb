"""Evidence-grounded entity analytics and training-data preparation as Spark jobs."""
