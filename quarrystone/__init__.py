"""A data-science expression library and analytics engine on Spark DataFrames."""
