"""K-mer and de Bruijn graph analytics on Spark DataFrames."""
