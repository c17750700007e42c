"""Operations of a training-data pipeline: filters, near-duplicates, tokens, fingerprints and shards."""
