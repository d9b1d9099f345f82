"""graphloom: a knowledge-graph and retrieval engine written as Spark jobs."""
