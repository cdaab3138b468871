"""Set-at-a-time operators over documents, line items and operational tables."""
