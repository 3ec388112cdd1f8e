"""The registered queries: each pairs a Spark job with the SQL that checks it."""
