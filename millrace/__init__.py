"""millrace: retrieval and evaluation over corpora of source files and documents, on Spark."""
