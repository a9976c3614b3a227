"""kinmer: sequence-mimicry analytics and corpus preparation as PySpark DataFrame transforms."""
