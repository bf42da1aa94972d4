"""docloom: document analytics and retrieval as Spark DataFrame jobs."""
