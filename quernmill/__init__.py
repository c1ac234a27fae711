"""quernmill: mining operators over review-style data, expressed on Spark DataFrames."""
