"""DataFrame to DataFrame operators; the batch and streaming jobs share them."""
