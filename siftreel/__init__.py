"""Media-file validation on Spark: tables of untrusted MP4 and WebP files in, one verdict per file out."""

__version__ = "0.1.0"
