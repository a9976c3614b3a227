"""Column expressions: sequences, alleles, variants and names."""
