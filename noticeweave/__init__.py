"""noticeweave: announcement intelligence on Spark DataFrames."""
