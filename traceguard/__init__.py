"""Security analytics over traces of language models and agents, as Spark DataFrames."""
