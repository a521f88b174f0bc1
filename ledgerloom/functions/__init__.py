"""Part of the document-analytics engine; see the README."""
