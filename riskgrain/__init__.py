"""Response analytics on Spark: binning, evidence tables, profiles, evaluation, sampling."""
