"""Speech-dataset curation, evaluation and service-log analytics as Spark DataFrame operators."""
