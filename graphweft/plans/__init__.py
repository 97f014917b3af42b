"""The query language: parser, binder and compiler to DataFrames."""
