"""dosecast: response prediction from described pairs, as Spark DataFrame jobs."""
