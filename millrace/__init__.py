"""millrace: job-posting analytics expressed as Spark DataFrame plans."""
