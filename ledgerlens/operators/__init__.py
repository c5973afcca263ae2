"""Row and table operators: mapping, validation, standardisation, helper
columns, view compilation, raw pages and catalog jobs."""
