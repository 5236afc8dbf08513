"""swipewatch: transaction-risk analytics written as Spark DataFrame jobs."""
