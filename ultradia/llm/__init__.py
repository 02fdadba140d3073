"""Operators for training data: similarity clusters, token ids, packing, residue. Nothing else imports this package."""
