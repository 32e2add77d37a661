"""graphloom: spectral comparison and alignment of large networks on Spark."""
