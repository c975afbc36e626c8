"""weftline: caption curation and embedding analytics on PySpark DataFrames."""
