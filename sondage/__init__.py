"""sondage: automated table analysis written as Spark DataFrame jobs."""
