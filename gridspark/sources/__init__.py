"""Scans: file listings, manifests, payload files, references, logs, generated data."""
