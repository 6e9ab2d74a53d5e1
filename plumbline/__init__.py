"""plumbline: a code-retrieval and corpus-preparation engine on Spark DataFrames."""
