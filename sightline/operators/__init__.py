"""DataFrame operators: filters, matching, metrics, transforms, alignment, the store."""
