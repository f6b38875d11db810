"""annolake: image-annotation catalogs, audits, rasters and scores as Spark DataFrames."""
