"""Readers of image and header files over Spark's binaryFile source; a file that cannot be read gives nulls, never an error."""
