"""quillmill: document analytics, retrieval and text preparation on Spark DataFrames."""
