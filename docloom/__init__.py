"""docloom: document metadata, queue, search and corpus operators on Spark DataFrames."""
