"""presswork: news collection, de-duplication, feeds and retrieval as Spark jobs.

Everything is a function from DataFrames to DataFrames. Importing the package
starts nothing; pass in your own session.
"""
