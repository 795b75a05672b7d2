"""archivolt: archive-integrity analytics on Spark DataFrames."""
