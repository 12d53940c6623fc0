"""Spark jobs for opportunity catalogues, document audits and event accounting."""
