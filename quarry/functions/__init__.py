"""Column expressions: parsing, text keys, masks, buckets and closed-form statistics."""
