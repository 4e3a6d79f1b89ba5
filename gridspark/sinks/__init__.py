"""Writers: reports, converted datasets."""
