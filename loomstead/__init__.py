"""Knowledge, retrieval, portfolio and corpus analytics as Spark DataFrame operators."""
