"""bitloom: parallel-corpus analytics as lazy Spark DataFrame plans."""
