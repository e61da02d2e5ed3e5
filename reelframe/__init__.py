"""Clip analytics on Spark: manifests, captions, focus tracking and crop paths as DataFrame queries."""
