"""Operators for preparing training data at scale: search, scoring, mixing, deduplication, packing, scans."""
