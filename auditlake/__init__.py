"""auditlake: document audit as DataFrames."""
