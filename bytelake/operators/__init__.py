"""Operators on blob tables: hashes, statistics, n-grams, signatures, features, classification, sniffing."""
